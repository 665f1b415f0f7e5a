"""Exact top-k search over posting lists by MaxScore.

A term is a position of the vector and a sign; its postings are the rows with a weight of that
sign. Only terms of the query's own signs can add to a score, by at most their bound: the query's
weight times the largest weight posted. With the terms in order of their bounds, the last ones whose
bounds together stay below the k-th best score so far are non-essential: a row that only they hold
cannot come in. Postings of the essential terms are traversed, the others are probed for the rows
that may still come in, bound after bound; what is left gets its exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelode.llm.blocks import QUERY_BLOCK, best, counted, matrix, met, part_of, parts_for, same_width, top
from hirelode.llm.common import prepare

SHARD_ROWS = 16_384
#: Rows between two updates of the score to beat.
STRIDE = 2_048


class Postings:
    """Posting lists of one shard, in order of the rows, and the rows themselves for probing."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = keys, weights
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        steps = np.arange(0, len(keys) + STRIDE, STRIDE)
        for term in range(weights.shape[1]):
            column = weights[:, term]
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                if len(rows):
                    posted = column[rows] * sign
                    self.lists[term, sign] = rows, posted, np.searchsorted(rows, steps), int(posted.max())

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best rows whose key is not `own`."""
        terms = []
        for term in np.flatnonzero(query):
            sign = 1 if query[term] > 0 else -1
            if (term, sign) in self.lists:
                weight = int(query[term]) * sign
                terms.append((weight * self.lists[term, sign][3], weight, int(term), sign))
        terms.sort(reverse=True)
        rest = np.append(np.cumsum([t[0] for t in terms][::-1])[::-1], 0).astype(np.int64)
        best_keys, best_scores = self.keys[:0], np.zeros(0, dtype=np.int64)
        to_beat = None
        for block, begin in enumerate(range(0, len(self.keys), STRIDE)):
            end = min(begin + STRIDE, len(self.keys))
            if to_beat is None or to_beat <= 0:  # rows without any of the terms may come in
                rows = np.arange(begin, end)
            else:
                essential = int(np.argmax(rest < to_beat))
                rows = self.candidates(terms, rest, essential, to_beat, block, begin, end)
            rows = rows[self.keys[rows] != own]
            scores = self.weights[rows] @ query
            if to_beat is not None:
                rows, scores = rows[scores >= to_beat], scores[scores >= to_beat]
            keys = np.concatenate([best_keys, self.keys[rows]])
            scores = np.concatenate([best_scores, scores])
            places = top(scores, keys, k)
            best_keys, best_scores = keys[places], scores[places]
            if len(best_keys) == k:
                to_beat = int(best_scores[-1])
        return best_keys, best_scores

    def candidates(self, terms, rest, essential, to_beat, block, begin, end) -> np.ndarray:
        """Rows of a block whose upper bound reaches the score to beat."""
        bound = np.zeros(end - begin, dtype=np.int64)
        for _, weight, term, sign in terms[:essential]:
            rows, posted, steps, _ = self.lists[term, sign]
            at = slice(steps[block], steps[block + 1])
            bound[rows[at] - begin] += weight * posted[at]
        alive = np.flatnonzero(bound + rest[essential] >= to_beat)
        bound = bound[alive]
        for place in range(essential, len(terms)):
            if not len(alive):
                break
            _, weight, term, sign = terms[place]
            bound = bound + weight * np.maximum(self.weights[alive + begin, term] * sign, 0)
            keep = bound + rest[place + 1] >= to_beat
            alive, bound = alive[keep], bound[keep]
        return alive + begin


def search(
    queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", weights: str = "weights",
    shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k rows of highest integer inner product for every query, ties to the smaller key.

    `queries` has query_id and the weights, `rows` the key and the weights: arrays of longs, in
    which the position is the term and zeros are not posted; a shorter array ends in zeros. The
    result is (query_id, rank from 1, key, score), all rows if there are fewer than k. A query's
    own row, the one with its id as key, is left out. Rows or queries with a null key or array take
    no part; nulls inside arrays are not allowed. Repeated rows are rows of their own. Every row of
    `queries` has its k rows: equal queries are searched once and the result repeated. Either table
    may be empty: no rows.

    Every shard meets every block of queries, in a task that holds one of each; shards are dealt by
    a hash of the key and merged by a window that keeps k rows per query ahead of the shuffle.
    """
    prepare(rows.sparkSession)
    posted = rows.select(F.col(key).alias("key"), F.col(weights).alias("weights")).dropna()
    asked = counted(queries.select("query_id", F.col(weights).alias("weights")).dropna(), "weights")
    n_shards, n_blocks = parts_for(posted.count(), shard_rows), parts_for(asked.count(), query_block)
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("place", T.LongType()), T.StructField("copies", T.LongType()),
        T.StructField("key", rows.schema[key].dataType), T.StructField("score", T.LongType()),
    ])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (
                ("query_id", right.schema.field("query_id").type), ("place", pa.int64()), ("copies", pa.int64()), ("key", left.schema.field("key").type),
                ("score", pa.int64()),
            )})
        held, wanted = same_width(matrix(left["weights"], np.int64), matrix(right["weights"], np.int64))
        shard = Postings(left["key"].to_numpy(), held)
        ids = right["query_id"].to_numpy()
        found = [shard.search(own, query, k) for own, query in zip(ids.tolist(), wanted, strict=True)]
        each = np.repeat(np.arange(len(ids)), [len(f[0]) for f in found])
        return pa.table({
            "query_id": pa.array(ids[each]),
            "place": pa.array(right["place"].to_numpy()[each]), "copies": pa.array(right["copies"].to_numpy()[each]),
            "key": pa.array(np.concatenate([f[0] for f in found])),
            "score": pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
        })

    shards = posted.withColumn("shard", part_of("key", n_shards))
    found = met(shards, asked, n_shards, n_blocks).applyInArrow(run, schema)
    return best(found.withColumnRenamed("key", key), k, key)
