"""The training-data pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode.llm import packing, quality, secrets, simhash, substring_dedup
from hirelode.llm.common import table
from hirelode.llm.queries import QUALITY_THRESHOLD
from hirelode.session import scratch_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; trained on the labelled ones among them."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_texts(docs, model, out="__llm_quality")
    return scored.filter(F.col("__llm_quality") >= QUALITY_THRESHOLD).drop("__llm_quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the smallest doc_id stays."""
    return simhash.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of nothing else goes."""
    return counted(substring_dedup.remove_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays."""
    return counted(secrets.redact(docs, secrets.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row per piece, with its ids."""
    return packing.pack_texts(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: No stage can be put in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, through tables in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
