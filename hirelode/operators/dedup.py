"""Keeping first rows, dropping known ones, inserting what is absent.

`first_per_key` is written as `row_number() = 1`, for which Spark keeps one row per key and task
before the shuffle (WindowGroupLimit), so a key with a third of all rows costs no more than the
others. Its result is hash-partitioned by the key, which the anti join that follows reuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.functions.text import first_match, non_blank, utrim, text_or_blank

DISCOVERY_ORDER = ("keyword_idx", "page_num", "card_idx", "posting_id")


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """First `k` rows of each group, with their position.

    Each task keeps `k` rows per group before the shuffle, as long as `k` does not exceed
    `spark.sql.optimizer.windowGroupLimitThreshold` (1,000 unless set).
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str] = DISCOVERY_ORDER
) -> DataFrame:
    """First row of each key in discovery order. `order` has to be total."""
    return top_k_per_group(df, key, order, 1, rank="_first").drop("_first")


def known_keys(history: DataFrame, key: str) -> DataFrame:
    """Distinct non-blank keys; duplicates collapse before the shuffle."""
    return history.select(utrim(key).alias(key)).filter(F.col(key) != "").distinct()


def unseen(
    df: DataFrame, seen: DataFrame, key: str, unique: bool = False, keyed: bool = False
) -> DataFrame:
    """Rows with a non-blank key that is not in `seen`.

    `unique=True` says the keys of `df` are not blank and occur once, as after `first_per_key`.
    `keyed=True` says that those of `seen` are trimmed and laid out by key (`sources.keyed`): they are
    joined where they lie.
    """
    rows = df if unique else df.filter(non_blank(key).isNotNull())
    known = seen.select(key) if keyed else known_keys(seen, key)
    return rows.join(known, key, "left_anti")


def new_listings(listings: DataFrame, processed: DataFrame, sponsored: Column) -> DataFrame:
    """Listings with a link that are neither sponsored nor processed."""
    return unseen(listings.filter(~sponsored), processed, "href")


def new_domains(
    listings: DataFrame, tracked: DataFrame, order: Sequence[Column | str] = ("listing_idx",)
) -> DataFrame:
    """First listing per domain that is not tracked yet; listings without a website stay."""
    without = listings.filter(F.col("domain").isNull())
    fresh = first_per_key(listings.filter(F.col("domain").isNotNull()), ["domain"], order)
    return fresh.join(tracked.select("domain").distinct(), "domain", "left_anti").unionByName(
        without
    )


def row_key(columns: Sequence[str], link: str, width: int = 8) -> Column:
    """Tagged key of a row: its link, or else its first `width` cells."""
    cells = F.array(*[utrim(text_or_blank(F.col(c).cast("string"))) for c in columns[:width]])
    address = non_blank(link)
    return F.when(
        address.isNotNull(), F.struct(F.lit("link").alias("tag"), F.array(address).alias("cells"))
    ).otherwise(F.struct(F.lit("row").alias("tag"), cells.alias("cells")))


def insert_if_absent(
    target: DataFrame,
    batch: DataFrame,
    columns: Sequence[str],
    link: str,
    order: Sequence[Column | str],
    width: int = 8,
) -> DataFrame:
    """Rows of `batch` whose key is neither in `target` nor earlier in the batch."""
    key = row_key(columns, link, width)
    keyed = first_per_key(batch.withColumn("_key", key), ["_key"], order)
    present = target.select(key.alias("_key")).distinct()
    return keyed.join(present, "_key", "left_anti").drop("_key")


def upsert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: how many rows were inserted and how many skipped."""
    tagged = batch.select(F.lit(0).alias("new")).unionAll(inserted.select(F.lit(1).alias("new")))
    return tagged.agg(
        F.count_if(F.col("new") == 1).alias("inserted"),
        (F.count_if(F.col("new") == 0) - F.count_if(F.col("new") == 1)).alias("skipped"),
    )


def drop_header_row(rows: DataFrame, header: Sequence[str], position: str = "pos") -> DataFrame:
    """Drop the row at position 0 if its trimmed cells are exactly the header."""
    cells = F.slice(F.col("cells"), 1, len(header))
    trimmed = F.transform(cells, lambda c: utrim(text_or_blank(c)))
    expected = F.array(*[F.lit(h) for h in header])
    return rows.filter(~((F.col(position) == 0) & (trimmed == expected)))


def merge_history(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows ahead of existing ones: generation 0 before generation 1."""
    return new.withColumn("generation", F.lit(0)).unionByName(
        existing.withColumn("generation", F.lit(1)), allowMissingColumns=True
    )


def unique_keywords(
    keywords: DataFrame, mode: str = "both", order: Sequence[str] = ("pos",)
) -> DataFrame:
    """First spelling of each keyword of a run mode, ignoring case and outer blanks."""
    chosen = (mode or "").strip().lower()
    rows = keywords if chosen not in ("data", "devops") else keywords.filter(F.col("mode") == chosen)
    if "mode" in keywords.columns and chosen not in ("data", "devops"):
        # Both lists: data keywords come first.
        first = first_match([(F.col("mode") == "data", 0)], 1)
        order = (first, *order)
    folded = F.lower(utrim("keyword"))
    return first_per_key(
        rows.withColumn("_folded", folded).filter(F.col("_folded") != ""), ["_folded"], order
    ).drop("_folded")
