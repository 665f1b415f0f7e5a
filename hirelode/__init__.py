"""Posting triage, website contacts and CV matching on Spark DataFrames."""
