"""Joins that keep every row of the left side, and a filter ahead of joins that do not.

The joins are plain shuffle joins against a right side of one row per key. A key with a large share of
the rows makes a large partition, which the adaptive skew join splits (`session.SETTINGS`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode.functions.text import text_or_blank, utrim

#: A membership filter has so many words of 64 bits at most: 16 MB, whatever the tables hold.
FILTER_WORDS = 1 << 20


def _bit(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 58).cast("int")


def _with_bits(df: DataFrame, keys: DataFrame, key: str, words: int, how: str) -> DataFrame:
    """The bits set by `keys` in the word that a row's key falls in, as column _bits."""
    place = F.xxhash64(key).bitwiseAND(words - 1)
    # F.shiftleft takes a fixed number of places only.
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key))
    table = keys.groupBy(place.alias("_word")).agg(F.bit_or(flag).alias("_bits"))
    return df.withColumn("_word", place).join(F.broadcast(table), "_word", how).drop("_word")


def may_be_in(df: DataFrame, keys: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """Rows of `df` whose key may be one of `keys`: all that are, and few others while keys are few.

    The hashes of the keys set bits of a fixed number of words, which go to every task, so that wide
    rows need no shuffle to be told apart. Beyond some ten million keys more and more rows pass; a join
    that follows decides, so none is lost and none too many stays.
    """
    met = _with_bits(df, keys, key, words, "inner")
    return met.filter(F.bit_get("_bits", _bit(key)) == 1).drop("_bits")


def flagged(df: DataFrame, keys: DataFrame, key: str, out: str, words: int = FILTER_WORDS) -> DataFrame:
    """All rows, with whether `may_be_in` would keep them as column `out`."""
    met = _with_bits(df, keys, key, words, "left")
    return met.withColumn(out, F.coalesce(F.bit_get("_bits", _bit(key)) == 1, F.lit(False))).drop("_bits")


def pending_recipients(recipients: DataFrame, sent: DataFrame, distinct: bool = False) -> DataFrame:
    """Recipients not in the sent log, ignoring case; duplicates stay unless `distinct`."""
    folded = recipients.withColumn("_address", F.lower("email"))
    if distinct:
        folded = folded.groupBy("_address").agg(
            F.min_by("email", "pos").alias("email"), F.min("pos").alias("pos")
        )
    return folded.join(_sent_addresses(sent), "_address", "left_anti").drop("_address")


def recipient_counts(recipients: DataFrame, sent: DataFrame) -> DataFrame:
    """One row: recipients in the list, distinct addresses already sent, rows still pending."""
    per_address = recipients.groupBy(F.lower("email").alias("_address")).agg(
        F.count(F.lit(1)).alias("n")
    )
    logged = _sent_addresses(sent).withColumn("done", F.lit(True))
    checked = per_address.join(logged, "_address", "left")
    return checked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if("done").alias("already_sent"),
        F.coalesce(F.sum(F.when(F.col("done").isNull(), F.col("n"))), F.lit(0)).alias("pending"),
    )


def _sent_addresses(sent: DataFrame) -> DataFrame:
    return (
        sent.select(F.lower(utrim("email")).alias("_address"))
        .filter(F.col("_address") != "")
        .distinct()
    )


def fill_from_lookup(
    companies: DataFrame,
    careers: DataFrame,
    company: str = "company",
    page: str = "Career Page",
    prefilled: dict[str, str] | None = None,
) -> DataFrame:
    """Fill a blank page of a named company from the lookup; all else stays as it is."""
    columns = companies.columns
    blank = (text_or_blank(company) != "") & (utrim(text_or_blank(page)) == "")
    lookup = careers.groupBy(F.col(company).alias("_wanted")).agg(
        F.min("career_page").alias("_found")
    )
    known = F.lit(None).cast("string")
    for name, url in (prefilled or {}).items():
        known = F.when(F.col(company) == name, url).otherwise(known)
    # Only the rows that need a page meet the lookup; the others are not shuffled.
    joined = companies.filter(blank).join(lookup, F.col(company) == F.col("_wanted"), "left")
    filled = joined.withColumn(page, F.coalesce(known, F.col("_found"), F.lit("")))
    return companies.filter(~blank).unionByName(filled.select(*columns))
