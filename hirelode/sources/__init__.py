"""Readers and writers: key files, posting rows, run folders."""
