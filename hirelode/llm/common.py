"""Column mapping in Arrow batches, label folds and bounded training samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 512
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ARROW_TYPES = {
    "string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(),
    "double": pa.float64(), "boolean": pa.bool_(),
    "array<struct<kind:string,start:bigint,end:bigint,value:bigint>>": pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()),
    ])),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings for Python on the executors; operators call it before they hand a function over.

    Arrow batches are counted in rows; texts may be long, so a batch holds fewer than by default.
    Workers look for this package where the driver has it, besides the places they know.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, ROOT) if p)


def texts_of(column: pa.Array) -> list[str]:
    """The values of a text column; null counts as the empty text."""
    return [value or "" for value in column.to_pylist()]


def with_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: dict[str, str],
    compute: Callable[..., Sequence[Sequence]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns that `compute` makes from the input columns, one Arrow batch at a time.

    `outputs` maps names to simple types. Kept columns (all by default) pass through as they are;
    one that has the name of an output is replaced.
    """
    prepare(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    needed = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([df.schema[c] for c in kept])
    made_fields = T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in outputs.items()))
    schema = T.StructType([*schema.fields, *made_fields.fields])
    names = [*kept, *outputs]
    kinds = [ARROW_TYPES[kind] for kind in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*(batch.column(needed.index(c)) for c in inputs))
            arrays = [batch.column(needed.index(c)) for c in kept]
            arrays += [pa.array(m, type=kind) for m, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)


FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out of all training."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def least_text(text: str = "text") -> Column:
    """Of the texts of a group that of the smallest hash."""
    return F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")))["text"]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list:
    """A bounded sample of labelled documents outside the held-out fold: (doc_id, text, label).

    Of either class the `per_class` rows with the smallest hash of doc_id, so that the sample
    does not depend on how the tables are split. Rows without a text or label take no part. Of rows
    that share a doc_id one counts, that of the smallest hash of its text.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold() != 0)).select("doc_id", label)
    picked = None
    for value in (0, 1):
        ids = known.filter(F.col(label) == value).select(
            F.xxhash64("doc_id").alias("order"), "doc_id", F.col(label).cast("int").alias("label")
        ).distinct().orderBy("order", "doc_id").limit(per_class)
        picked = ids if picked is None else picked.union(ids)
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(picked), "doc_id")
    # One row of each picked id: at most 2 * per_class, whatever the tables hold.
    rows = found.groupBy("doc_id", "label", "order").agg(least_text().alias("text"))
    return sorted(rows.collect(), key=lambda r: (r.order, r.doc_id, r.text))
