"""Run summaries. Everything here combines per task before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.classify import location_zone, zone_rank

RELEVANT = ("high_relevant", "relevant")


def only_relevant(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("relevance").isin(*RELEVANT))


def run_summary(triaged: DataFrame, target: int = rules.DAILY_TARGET) -> DataFrame:
    """One row: totals per label, whether the target is reached and what is missing."""
    counts = triaged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("relevance") == "high_relevant").alias("high_relevant"),
        F.count_if(F.col("relevance") == "relevant").alias("relevant"),
        F.count_if(F.col("relevance") == "non_relevant").alias("non_relevant"),
    )
    return _judged(counts, target)


def _judged(counts: DataFrame, target: int) -> DataFrame:
    found = F.col("high_relevant") + F.col("relevant")
    return counts.withColumn("target_reached", found >= target).withColumn(
        "missing", F.greatest(F.lit(target) - found, F.lit(0).cast("bigint"))
    )


def zone_breakdown(triaged: DataFrame) -> DataFrame:
    """Relevant rows per zone in ranking order; zones without any do not appear.

    Counted with a condition rather than filtered first: Spark would push such a filter below the
    classification and classify every row twice.
    """
    counted = triaged.groupBy("location_zone").agg(
        F.count_if(F.col("relevance").isin(*RELEVANT)).alias("postings")
    )
    return _ranked(counted)


def _ranked(counted: DataFrame) -> DataFrame:
    shown = F.col("location_zone").isin(*rules.ZONE_RANKING) & (F.col("postings") > 0)
    return counted.filter(shown).withColumn("zone_order", zone_rank("location_zone")).orderBy(
        "zone_order"
    )


def partial_summary(triaged: DataFrame) -> DataFrame:
    """(location_zone, relevance, postings): what a run adds to every summary; a few rows, to be stored."""
    return triaged.groupBy("location_zone", "relevance").agg(F.count(F.lit(1)).alias("postings"))


def merged_run_summary(partials: DataFrame, target: int = rules.DAILY_TARGET) -> DataFrame:
    """`run_summary` of all postings that the partial summaries count."""

    def of(condition: Column | None = None) -> Column:
        counted = F.col("postings") if condition is None else F.when(condition, F.col("postings"))
        return F.coalesce(F.sum(counted), F.lit(0))

    label = F.col("relevance")
    return _judged(partials.agg(
        of().alias("total"),
        of(label == "high_relevant").alias("high_relevant"),
        of(label == "relevant").alias("relevant"),
        of(label == "non_relevant").alias("non_relevant"),
    ), target)


def merged_zone_breakdown(partials: DataFrame) -> DataFrame:
    """`zone_breakdown` of all postings that the partial summaries count."""
    counted = partials.groupBy("location_zone").agg(
        F.coalesce(F.sum(F.when(F.col("relevance").isin(*RELEVANT), F.col("postings"))), F.lit(0)).alias("postings")
    )
    return _ranked(counted)


def merged_visit_totals(partials: DataFrame, status: str = "status") -> DataFrame:
    """`visit_totals` of all visits counted by `visits_per_status`."""

    def of(value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(status) == value, F.col("visits"))), F.lit(0))

    return partials.agg(
        of("connect").alias("connects"),
        of("follow").alias("follows"),
        of("visited_only").alias("visited_only"),
        F.coalesce(F.sum("visits"), F.lit(0)).alias("total_visits"),
    )


def relevance_split(df: DataFrame, relevant: str = "relevant") -> tuple[DataFrame, DataFrame]:
    """Rows labelled relevant, and the others."""
    return df.filter(F.col(relevant)), df.filter(~F.col(relevant))


def relevance_share(df: DataFrame, relevant: str = "relevant") -> DataFrame:
    return df.agg(
        F.count_if(relevant).alias("relevant"),
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col(relevant).cast("double")).alias("share"),
    )


def visit_totals(visits: DataFrame, status: str = "status") -> DataFrame:
    """One row: connects, follows, visits without either, all visits."""
    return visits.agg(
        F.count_if(F.col(status) == "connect").alias("connects"),
        F.count_if(F.col(status) == "follow").alias("follows"),
        F.count_if(F.col(status) == "visited_only").alias("visited_only"),
        F.count(F.lit(1)).alias("total_visits"),
    )


def visits_per_status(visits: DataFrame, status: str = "status") -> DataFrame:
    return visits.groupBy(status).agg(F.count(F.lit(1)).alias("visits"))


def backfill_zone(rows: DataFrame) -> DataFrame:
    """Fill a blank zone from the location."""
    zone = F.coalesce(F.nullif("location_zone", F.lit("")), location_zone("location"))
    return rows.withColumn("location_zone", zone)
