"""Operators that need a global order, without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.functions.classify import zone_rank
from hirelode.operators.dedup import DISCOVERY_ORDER
from hirelode.session import materialize

# monotonically_increasing_id: partition number above bit 33, position in the partition below.
PARTITION_BITS = 33


def numbered(ordered: DataFrame, position: str = "position") -> DataFrame:
    """Position 1, 2, 3 … of every row of a sorted table.

    A row's position is that in its partition plus the sizes of the partitions before it; only one
    row per partition meets in a single task. The sorted rows are checkpointed because the sampled
    partition bounds must not change between the two uses.
    """
    placed = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", PARTITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    within = F.col("_id").bitwiseAND((1 << PARTITION_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(position, within + F.col("_before") + 1)
        .drop("_part", "_id", "_before")
    )


def global_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    rank: str = "rank",
) -> DataFrame:
    """Position of every row in a total order: one range shuffle, see `numbered`."""
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), rank)


def posting_order(tie: Sequence[str] = DISCOVERY_ORDER) -> list[Column]:
    return [zone_rank("location_zone"), F.col("relevance_score").desc(), *map(F.col, tie)]


def sort_postings(relevant: DataFrame, tie: Sequence[str] = DISCOVERY_ORDER) -> DataFrame:
    """Best zone first, then score, then discovery order: a distributed sort."""
    return relevant.orderBy(*posting_order(tie))


def rank_postings(relevant: DataFrame, tie: Sequence[str] = DISCOVERY_ORDER) -> DataFrame:
    """The order of `sort_postings` as a column."""
    return global_rank(relevant, posting_order(tie))


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    alias: str = "previous",
) -> DataFrame:
    """Last non-null `value` before each row of its group, in a total order of the group.

    A group may hold a third of all rows, so rows are dealt by ranges of group and order, and a task
    sees the part of a group that lies in one range. What reaches over a border comes from a summary of
    one row per range: its first group, its last, and the last value in that. The dealt rows are
    checkpointed, since the sampled bounds must not change between the two uses.
    """
    # A struct is never null, so rows with a null in the group columns are a group like the others.
    dealt = df.withColumn("_group", F.struct(*group)).repartitionByRange("_group", *order)
    placed = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("_part", "_group").orderBy(*order).rowsBetween(*before)
    return (
        placed.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(F.broadcast(_carried(placed, order, value)), ["_part", "_group"], "left")
        .withColumn(alias, F.coalesce("_inside", "_carried"))
        .select(*df.columns, alias)
    )


def _carried(placed: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """(_part, _group, _carried): what the first group of each range takes over from the ranges before it.

    As many rows as there are ranges; a group's ranges lie side by side and are scanned in order.
    """
    held = F.when(F.col(value).isNotNull(), F.struct("_group", *order))
    ends = placed.groupBy("_part").agg(
        F.min("_group").alias("first"),
        F.max("_group").alias("last"),
        F.max_by(F.struct("_group", F.col(value).alias("value")), held).alias("latest"),
    )
    of_last = F.when(F.col("latest._group") == F.col("last"), F.col("latest.value"))
    asked = ends.select("_part", F.lit(0).alias("kind"), F.col("first").alias("_group"), F.lit(None).alias("value"))
    given = ends.select("_part", F.lit(1).alias("kind"), F.col("last").alias("_group"), of_last.alias("value"))
    earlier = Window.partitionBy("_group").orderBy("_part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    scanned = asked.unionByName(given).withColumn("_carried", F.last("value", ignorenulls=True).over(earlier))
    return scanned.filter("kind = 0").select("_part", "_group", "_carried")


def session_cap(profiles: DataFrame, n: int, key: str = "profile_url") -> DataFrame:
    """First `n` profiles of a session in URL order: a top-k, not a full sort."""
    return profiles.orderBy(key).limit(n)


def page_cap(postings: DataFrame, n: int) -> DataFrame:
    """Result pages 1 to `n` of each keyword."""
    return postings.filter(F.col("page_num").between(1, n))


def sorted_distinct(keys: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().orderBy(key)
