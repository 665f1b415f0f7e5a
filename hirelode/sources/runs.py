"""Run folders: one partition per day, time and relevance; all partitions are the history."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.operators.report import RELEVANT
from hirelode.streaming.dedup import within_retention

PARTITIONS = ("run_day", "run_time", "relevance_split")
SPLITS = ("relevant", "non_relevant")


def split_of(relevance: str = "relevance") -> Column:
    kept = F.col(relevance).isin(*RELEVANT, "yes")
    return F.when(kept, SPLITS[0]).otherwise(SPLITS[1])


def write_run(df: DataFrame, path: str, run_ts: datetime, relevance: str = "relevance") -> None:
    """Write one run. Writing the same run again replaces its partitions and no others."""
    tagged = df.withColumns(
        {
            "run_day": F.lit(run_ts.strftime("%Y-%m-%d")),
            "run_time": F.lit(run_ts.strftime("%H-%M")),
            "relevance_split": split_of(relevance),
        }
    )
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTITIONS).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; partition values stay text."""
    return spark.read.parquet(path).withColumns({c: F.col(c).cast("string") for c in PARTITIONS})


def write_summary(partials: DataFrame, path: str, run_id: int) -> None:
    """Store the partial summary of a run; that of a run that is run again replaces it."""
    tagged = partials.withColumn("run_id", F.lit(run_id).cast("bigint")).coalesce(1)
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def retained(runs: DataFrame, time: str, now: datetime, hours: int = rules.RETENTION_HOURS) -> DataFrame:
    """Rows of run folders at most `hours` old at `now`; folders of older days are not scanned.

    A row is no younger than its run, so a folder of a day before the border has none to keep: a row
    stamped later than its own run goes with the folder. Rows without a time go.
    """
    border = now - timedelta(hours=hours)
    recent = runs.filter(F.col("run_day") >= border.strftime("%Y-%m-%d"))
    return within_retention(recent, time, F.lit(now), hours)


def drop_old_runs(spark: SparkSession, path: str, now: datetime, hours: int = rules.RETENTION_HOURS) -> list[str]:
    """Delete the folders of days that lie wholly beyond the retention; returns these days.

    The day of the border stays, whole, and so does any folder that is not of a day.
    """
    border = (now - timedelta(hours=hours)).strftime("%Y-%m-%d")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    dropped = []
    for entry in store.listStatus(root):
        name, _, day = entry.getPath().getName().partition("=")
        if name == PARTITIONS[0] and re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and day < border:
            store.delete(entry.getPath(), True)
            dropped.append(day)
    return sorted(dropped)


def latest_run(runs: DataFrame, day: str) -> DataFrame:
    """Rows of the latest run of the day per split; a split without one gives its whole history.

    The condition reads partition columns and two scalars only, so folders are pruned before
    anything is scanned.
    """
    chosen = F.lit(False)
    for split in SPLITS:
        mine = F.col("relevance_split") == split
        latest = runs.filter(mine & (F.col("run_day") == day)).agg(F.max("run_time")).scalar()
        today = (F.col("run_day") == day) & (F.col("run_time") == latest)
        chosen = chosen | (mine & (latest.isNull() | today))
    return runs.filter(chosen)
