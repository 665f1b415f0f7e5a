"""Shards of a table against blocks of queries, and the merge of their results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4_096


def part_of(key: str, parts: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(parts)).cast("int")


def parts_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def counted(queries: DataFrame, weights: str) -> DataFrame:
    """Equal queries as one: (query_id, weights, place, copies).

    `place` numbers the queries of one id that differ, `copies` says how many rows a query has.
    """
    once = queries.groupBy("query_id", weights).agg(F.count("*").alias("copies"))
    same = Window.partitionBy("query_id").orderBy(weights)
    return once.withColumn("place", F.row_number().over(same).cast("long"))


def met(shards: DataFrame, queries: DataFrame, n_shards: int, n_blocks: int):
    """Every shard with every block of queries: a cogroup keyed (shard, block).

    `shards` has a column shard. Its rows are copied once per block and the queries once per shard,
    so that each task holds one shard and one block, both of bounded size. Queries are dealt by id and
    place.
    """
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    dealt = F.pmod(F.xxhash64(F.lit(1), "query_id", "place"), F.lit(n_blocks)).cast("int")
    right = queries.withColumn("block", dealt).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    )
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))


def best(found: DataFrame, k: int, key: str) -> DataFrame:
    """The k highest scores of each query, ties to the smaller key: (query_id, rank, key, score).

    `found` has the place and copies of `counted`; the result is repeated for each copy of a query.
    """
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), F.asc(key))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")
    return ranked.select("query_id", "rank", key, "score", each).drop("copy")


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    joined = column.combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks)
    lengths = joined.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = joined.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    made = np.zeros((len(lengths), width), dtype=dtype)
    made[np.arange(width) < lengths[:, None]] = values
    return made


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def top(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller key."""
    return np.lexsort((keys, -scores))[:k]
