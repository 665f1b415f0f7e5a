"""Posting files: comma-separated, quoted, all strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.classify import it_related
from hirelode.functions.text import utrim
from hirelode.operators.dedup import first_per_key
from hirelode.sources.keys import file_position, no_position

ROWS_PER_FILE = 200_000


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file whose header names the columns; quoted line breaks are kept."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def write_rows(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = rules.POSTING_FIELDS,
    mode: str = "overwrite",
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Fixed columns in fixed order; what is missing is written as an empty cell.

    A file with quoted line breaks is read by one task, so no file gets more than `rows_per_file`.
    """
    present = set(df.columns)
    cells = [
        F.coalesce(F.col(f"`{c}`").cast("string") if c in present else F.lit(None), F.lit("")).alias(c)
        for c in columns
    ]
    options = {
        "header": True, "escape": '"', "emptyValue": "", "nullValue": "",
        "maxRecordsPerFile": rows_per_file,
    }
    df.select(*cells).write.mode(mode).options(**options).csv(path)


def combine_history(files: Sequence[DataFrame]) -> DataFrame:
    """Rows of several posting files, first row per link in file order.

    A file without a time filter or a label gets them filled in; rows without a link go. Each
    file needs a total order inside itself, given as column `pos`.
    """
    ranked = []
    for number, rows in enumerate(files):
        if "Time Filter" not in rows.columns:
            rows = rows.withColumn("Time Filter", F.lit("Unknown"))
        if "Relevance" not in rows.columns:
            rows = rows.withColumn("Relevance", it_related("Job Title", "Keyword"))
        ranked.append(rows.withColumn("file", F.lit(number)))
    union = ranked[0]
    for rows in ranked[1:]:
        union = union.unionByName(rows, allowMissingColumns=True)
    linked = union.withColumn("_link", utrim(F.coalesce("Apply Link", F.lit("")))).filter(
        F.col("_link") != ""
    )
    return first_per_key(linked, ["_link"], ["file", "pos"]).drop("_link")


def read_history(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`combine_history` over the files that exist, each in its own row order."""
    files = []
    for path in paths:
        try:
            files.append(read_rows(spark, path).withColumn("pos", file_position()))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not files:
        schema = ", ".join(f"`{c}` string" for c in rules.POSTING_FIELDS)
        files = [spark.createDataFrame([], schema).withColumn("pos", no_position())]
    return combine_history(files)
