"""Text files with one key per line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode.functions.emails import normalize_email
from hirelode.functions.text import utrim


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines(value, pos) of a text file or folder; a missing path is an empty table."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string").withColumn("pos", no_position())
    return lines.select("value", file_position().alias("pos"))


def file_position() -> Column:
    """Order of the lines of a file: splits by their offset, lines of a split by their number."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("line"),
    )


def no_position() -> Column:
    return F.lit(None).cast("struct<file:string,offset:bigint,line:bigint>")


def read_keys(spark: SparkSession, path: str, key: str = "key", lower: bool = False) -> DataFrame:
    """Trimmed, non-blank, distinct keys."""
    trimmed = utrim("value")
    lines = read_lines(spark, path).select((F.lower(trimmed) if lower else trimmed).alias(key))
    return lines.filter(F.col(key) != "").distinct()


def read_recipients(spark: SparkSession, path: str) -> DataFrame:
    """recipients(pos, email): trimmed non-blank lines; order and duplicates stay."""
    lines = read_lines(spark, path).select("pos", utrim("value").alias("email"))
    return lines.filter(F.col("email") != "")


def read_clean_emails(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses that pass the screening."""
    lines = read_lines(spark, path).select(normalize_email("value").alias("email"))
    return lines.filter(F.col("email").isNotNull()).distinct()


def write_sorted_keys(keys: DataFrame, path: str, key: str = "key", emails: bool = False) -> None:
    """Distinct keys in ascending order over the part files, one per line.

    The sort is by ranges, so every task writes its own part of the order.
    """
    value = normalize_email(key) if emails else F.col(key)
    lines = keys.select(value.alias("value")).filter(F.col("value").isNotNull()).distinct()
    lines.orderBy("value").write.mode("overwrite").text(path)


def append_keys(keys: DataFrame, path: str, key: str = "key", lower: bool = False) -> None:
    """Append trimmed keys to a log."""
    trimmed = utrim(key)
    keys.select((F.lower(trimmed) if lower else trimmed).alias("value")).write.mode("append").text(path)
