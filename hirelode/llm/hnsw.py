"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

A shard holds a bounded number of distinct vectors. Each gets a random top layer; in every layer it
links to neighbours chosen by the diversity rule, both ways, in a flat array of fixed width. Layers
are built in bulk: since a shard is small, the candidates of each vector come from blocked products
within the layer. Queries go down from the top layer and walk the lowest one with a beam, a block of
them in lock step. For inner products a further component brings all vectors of a shard to one norm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelode.llm.blocks import QUERY_BLOCK, best, counted, matrix, met, part_of, parts_for, same_width
from hirelode.llm.common import prepare

SHARD_ROWS = 8_192
LINKS = 16
CANDIDATES = 48
BEAM = 96
#: Beam of the upper layers. All its points are gone on from, since a group of many vectors close together
#: has no links out of it: a descent by the nearest alone that enters the wrong one does not leave it.
UPPER_BEAM = 64
STEP = 256
INDEX_SCHEMA = (
    "shard int, width int, layers int, kept int, vectors binary, norms binary, id_ends binary, ids binary, "
    "sizes binary, members binary, neighbours binary"
)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One component more, so that all have the norm of the longest."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    return np.column_stack([vectors, np.sqrt(np.maximum(square.max() - square, 0.0))])


def nearest(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` nearest other points of each, nearest first, and their products."""
    n = len(points)
    count = min(count, n - 1)
    places, products = np.empty((n, count), dtype=np.int32), np.empty((n, count))
    for at in range(0, n, STEP):
        rows = np.arange(at, min(at + STEP, n))
        near = points[rows] @ points.T
        near[np.arange(len(rows)), rows] = -np.inf
        some = np.argpartition(-near, count - 1, axis=1)[:, :count] if count < n else near.argsort(axis=1)
        value = np.take_along_axis(near, some, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        places[rows] = np.take_along_axis(some, order, axis=1)
        products[rows] = np.take_along_axis(value, order, axis=1)
    return places, products


def diverse(points: np.ndarray, places: np.ndarray, products: np.ndarray, links: int) -> np.ndarray:
    """Choose links: a candidate nearer to the point than to any chosen one, then the nearest left."""
    n, count = places.shape
    chosen = np.full((n, links), -1, dtype=np.int32)
    for at in range(0, n, STEP):
        rows = slice(at, min(at + STEP, n))
        near, value = places[rows], products[rows]
        between = np.einsum("rid,rjd->rij", points[near], points[near])
        taken = np.zeros(near.shape, dtype=bool)
        for i in range(count):
            closest = np.where(taken, between[:, i, :], -np.inf).max(axis=1)
            taken[:, i] = (value[:, i] > closest) & (taken.sum(axis=1) < links)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :links]
        chosen[rows, : order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return chosen


def layer(points: np.ndarray, links: int) -> np.ndarray:
    """Neighbours of one layer, (points, 2 * links), -1 where there are fewer; links run both ways."""
    n = len(points)
    made = np.full((n, 2 * links), -1, dtype=np.int32)
    if n < 2:
        return made
    places, products = nearest(points, CANDIDATES)
    forward = diverse(points, places, products, min(links, places.shape[1]))
    made[:, : forward.shape[1]] = forward
    source, slot = np.nonzero(forward >= 0)
    target = forward[source, slot]
    value = np.einsum("ij,ij->i", points[source], points[target])
    order = np.lexsort((-value, target))
    source, target = source[order], target[order]
    starts = np.searchsorted(target, np.arange(n))
    place = np.arange(len(target)) - starts[target] + (made[target] >= 0).sum(axis=1)
    mutual = (made[target] == source[:, None]).any(axis=1)
    fits = (place < 2 * links) & ~mutual
    made[target[fits], place[fits]] = source[fits]
    return made


def build_shard(shard: int, vectors: np.ndarray, ids: list[np.ndarray], k: int = 20, links: int = LINKS) -> dict:
    points = lifted(vectors)
    draw = np.random.RandomState(shard).random_sample(len(points))
    tops = np.minimum((-np.log(1.0 - draw) / np.log(links)).astype(int), 8)
    members = [np.flatnonzero(tops >= level).astype(np.int32) for level in range(tops.max() + 1)]
    flat = [layer(points[m], links) for m in members]
    return {
        "shard": shard, "width": vectors.shape[1], "layers": len(members), "kept": k + 1,
        "vectors": vectors.tobytes(), "norms": points[:, -1].tobytes(),
        "id_ends": np.cumsum([len(i) for i in ids]).astype(np.int64).tobytes(),
        "ids": np.concatenate(ids).astype(np.int64).tobytes(),
        "sizes": np.array([len(m) for m in members], dtype=np.int64).tobytes(),
        "members": np.concatenate(members).tobytes(),
        "neighbours": b"".join(f.tobytes() for f in flat),
    }


class Graph:
    """A shard read back from its row."""

    def __init__(self, row: dict, links: int = LINKS):
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
        self.points = np.column_stack([self.vectors, np.frombuffer(row["norms"])])
        self.id_ends = np.frombuffer(row["id_ends"], dtype=np.int64)
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        ends = np.cumsum(sizes)
        members = np.frombuffer(row["members"], dtype=np.int32)
        flat = np.frombuffer(row["neighbours"], dtype=np.int32).reshape(-1, 2 * links)
        self.members = [members[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        self.flat = [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]

    def walk(self, level: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
        """Places in the layer of the beam's points for each query, nearest first, -1 where fewer.

        `entry` has the places to start from, in the same form.
        """
        points, flat = self.points[self.members[level]], self.flat[level]
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(points) + 1), dtype=bool)  # the last column stands for -1
        seen[:, -1] = True
        held = np.full((n, beam), -1, dtype=np.int64)
        value = np.full((n, beam), -np.inf)
        done = np.ones((n, beam), dtype=bool)
        first = slice(0, min(beam, entry.shape[1]))
        entry = entry[:, first]
        held[:, first], done[:, first] = entry, entry < 0
        value[:, first] = np.where(entry < 0, -np.inf, np.einsum("ijk,ik->ij", points[entry], queries))
        seen[rows[:, None], entry] = True
        while True:
            active = np.flatnonzero(~done.all(axis=1))
            if not len(active):
                return held
            place = np.argmax(~done[active], axis=1)  # the beam is sorted: the nearest not yet gone through
            done[active, place] = True
            around = flat[held[active, place]]
            fresh = ~seen[active[:, None], around]
            seen[active[:, None], around] = True
            product = np.einsum("ijk,ik->ij", points[around], queries[active])
            product[~fresh] = -np.inf
            every = np.concatenate([value[active], product], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            value[active] = np.take_along_axis(every, order, axis=1)
            held[active] = np.take_along_axis(np.concatenate([held[active], around], axis=1), order, axis=1)
            gone = np.concatenate([done[active], ~fresh], axis=1)
            done[active] = np.take_along_axis(gone, order, axis=1)
            held[value == -np.inf] = -1

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Places of the shard's vectors, nearest first, -1 where there are fewer."""
        asked = np.column_stack([queries, np.zeros(len(queries))])
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for level in range(len(self.members) - 1, 0, -1):
            held = self.walk(level, asked, entry, UPPER_BEAM)
            below = np.searchsorted(self.members[level - 1], self.members[level][held])
            entry = np.where(held < 0, -1, below)
        return self.walk(0, asked, entry, beam)

    def ids_of(self, place: int) -> np.ndarray:
        return self.ids[self.id_ends[place - 1] if place else 0 : self.id_ends[place]]


def finite(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) in double precision, of rows with a key and a vector of finite components."""
    named = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.filter(F.col("key").isNotNull() & good)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The finite rows whose vectors are not zero."""
    return finite(df, key, vector).filter(F.exists("vector", lambda x: x != 0))


def build(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row per shard: its distinct vectors, the keys of each, and the flat neighbour arrays.

    Every row is indexed. Of the keys of equal vectors the k + 1 smallest are kept, as many as an
    answer of k rows without the query's own can hold, so a vector that a third of the rows have is
    one point. Keys that are null and vectors that are null, zero or hold null or non-finite
    components take no part. Vectors should have one length; shorter ones end in zeros. Write the
    result to a table to search it again, for at most the k it was built with.
    """
    prepare(df.sparkSession)
    same = Window.partitionBy("vector").orderBy("key")
    few = usable(df, key, vector).distinct().withColumn("place", F.row_number().over(same))
    few = few.filter(F.col("place") <= k + 1)
    points = few.groupBy("vector").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    n_shards = parts_for(points.count(), shard_rows)

    def run(group: pa.Table) -> pa.Table:
        lists = [np.array(v, dtype=np.int64) for v in group["keys"].to_pylist()]
        # The order of arrival must not decide, nor the level of a vector.
        order = np.argsort([v[0] for v in lists], kind="stable")
        vectors = matrix(group["vector"], np.float64)[order]
        row = build_shard(group["shard"][0].as_py(), vectors, [lists[i] for i in order], k)
        kinds = dict.fromkeys(("shard", "width", "layers", "kept"), pa.int32())
        return pa.table({n: pa.array([v], type=kinds.get(n, pa.binary())) for n, v in row.items()})

    dealt = points.withColumn("shard", part_of("vector", n_shards))
    return dealt.groupBy("shard").applyInArrow(run, INDEX_SCHEMA)


def search(
    index: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    beam: int = BEAM, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest found of every query by inner product: (query_id, rank, key, score).

    `queries` has query_id and the vector. Scores are inner products of the vectors as given, in
    double precision; ties go to the smaller key; the row that has the query's id is left out.
    Every row of `queries` has its k rows: equal queries are searched once and the result repeated.
    Queries of vectors that take no part get no rows; an empty index gives none. The lowest layer is
    walked with a beam of at least 2 (k + 1) points. A k over the one the index was built with is an error,
    as the index may lack keys of equal vectors.
    """
    beam = max(beam, 2 * (k + 1))
    prepare(index.sparkSession)
    asked = counted(usable(queries, "query_id", vector).withColumnRenamed("key", "query_id"), "vector")
    sizes = index.agg(F.max("shard").alias("last"), F.min("kept").alias("kept")).first()
    if sizes.kept is not None and sizes.kept < k + 1:
        raise ValueError(f"the index was built for k = {sizes.kept - 1}")
    if sizes.last is None:
        none = (F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score"))
        return best(asked.select("query_id", "place", "copies", *none).limit(0), k, key)
    n_shards, n_blocks = sizes.last + 1, parts_for(asked.count(), query_block)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        each, keys, scores = [], [], []
        if left.num_rows and right.num_rows:
            graph = Graph(left.to_pylist()[0])
            ids = right["query_id"].to_numpy()
            held, wanted = same_width(graph.vectors[:1], matrix(right["vector"], np.float64))
            wanted = wanted[:, : held.shape[1]] if held.shape[1] == graph.vectors.shape[1] else wanted
            for at in range(0, len(ids), STEP):
                block = wanted[at : at + STEP, : graph.vectors.shape[1]]
                walked = enumerate(zip(ids[at:].tolist(), block, graph.search(block, beam), strict=False), at)
                for number, (own, query, places) in walked:
                    places = places[places >= 0][: k + 1]
                    score = graph.vectors[places] @ query
                    several = [graph.ids_of(p) for p in places.tolist()]
                    found = np.concatenate(several)
                    value = np.repeat(score, [len(s) for s in several])
                    found, value = found[found != own], value[found != own]
                    order = np.lexsort((found, -value))[:k]
                    each += [number] * len(order)
                    keys.append(found[order])
                    scores.append(value[order])
        none, each = np.zeros(0), np.array(each, dtype=np.int64)
        asking = {c: right[c].to_numpy().astype(np.int64)[each] for c in ("query_id", "place", "copies")}
        return pa.table({
            **{c: pa.array(v) for c, v in asking.items()},
            "key": pa.array(np.concatenate([none.astype(np.int64), *keys])),
            "score": pa.array(np.concatenate([none, *scores])),
        })

    found = met(index, asked, n_shards, n_blocks).applyInArrow(run, "query_id bigint, place bigint, copies bigint, key bigint, score double")
    return best(found.withColumnRenamed("key", key), k, key)
