"""Exact and approximate vector search against full products."""

import numpy as np
import pytest

from hirelode.llm import hnsw, maxscore
from hirelode.llm.queries import op2_maxscore, op3_hnsw
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")


def ranked(scores, keys, own, k):
    order = [i for i in np.lexsort((keys, -scores)) if keys[i] != own][:k]
    return [(int(keys[i]), scores[i]) for i in order]


@pytest.mark.parametrize("sparse", [False, True])
def test_maxscore_equals_full_products(monkeypatch, sparse):
    monkeypatch.setattr(maxscore, "STRIDE", 16)
    draw = np.random.RandomState(1)
    weights = draw.randint(-9, 10, size=(300, 12))
    if sparse:
        weights[draw.random_sample(weights.shape) < 0.7] = 0
    weights[50:90] = weights[7]
    keys = draw.permutation(300).astype(np.int64)
    shard = maxscore.Postings(keys, weights.astype(np.int64))
    for i in range(0, 300, 5):
        for k in (1, 5, 400):
            found, scores = shard.search(int(keys[i]), weights[i].astype(np.int64), k)
            expected = ranked(weights @ weights[i], keys, keys[i], k)
            assert list(zip(found.tolist(), scores.tolist(), strict=True)) == expected


def test_maxscore_over_shards_and_blocks(spark):
    draw = np.random.RandomState(2)
    weights = draw.randint(-5, 6, size=(120, 6))
    rows = [(i, w.tolist()) for i, w in enumerate(weights)] + [(200, None), (None, [1] * 6), (201, []), (202, [3])]
    table = spark.createDataFrame(rows, "vec_id bigint, weights array<bigint>")
    queries = table.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = maxscore.search(queries, table, 4, shard_rows=25, query_block=3).collect()
    full = np.zeros((122, 6), dtype=int)
    full[:120], full[121, 0] = weights, 3
    keys = np.array([*range(120), 201, 202])
    for query in range(0, 120, 10):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == query)
        expected = ranked(full @ weights[query], keys, query, 4)
        assert mine == [(n + 1, key, int(s)) for n, (key, s) in enumerate(expected)]
    assert maxscore.search(queries, table.limit(0), 4).collect() == []
    assert maxscore.search(queries.limit(0), table, 4).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_hnsw_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.collect()
    points = np.array([r.embedding for r in rows], dtype=np.float64)
    keys = np.array([r.vec_id for r in rows])
    got = op3_hnsw(spark, SMALL).collect()
    index = hnsw.build(table, shard_rows=100)
    several = hnsw.search(index, table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), query_block=7)
    for found in (got, several.collect()):
        hits = total = 0
        for query in keys[keys % 20 == 0]:
            product = points @ points[keys == query][0]
            mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == query)
            assert [r for r, _, _ in mine] == list(range(1, 21))
            assert [s for _, _, s in mine] == sorted([s for _, _, s in mine], reverse=True)
            for _, key, score in mine:
                assert score == pytest.approx(product[keys == key][0], abs=1e-12)
            hits += len({k for _, k, _ in mine} & {k for k, _ in ranked(product, keys, query, 20)})
            total += 20
        assert hits / total >= 0.95


def test_hnsw_finds_many_copies_and_skips_unusable_rows(spark):
    draw = np.random.RandomState(3)
    plain = draw.randn(60, 8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(plain)]
    rows += [(1_000 + i, plain[5].tolist(), 0) for i in range(500)] + [(5, plain[5].tolist(), 0)]
    rows += [(2_000, None, 0), (2_020, [0.0] * 8, 0), (2_040, [NAN] * 8, 0), (2_060, [INF] + [0.0] * 7, 0),
             (2_080, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0)]
    table = vectors(spark, rows)
    queries = table.filter("vec_id % 20 = 0 OR vec_id = 5").withColumnRenamed("vec_id", "query_id").distinct()
    got = hnsw.search(hnsw.build(table), queries).collect()
    mine = [r.vec_id for r in sorted((r for r in got if r.query_id == 5), key=lambda r: r["rank"])]
    assert mine == list(range(1_000, 1_020))
    assert {r.query_id for r in got} == {0, 20, 40, 5, *range(1_000, 1_500, 20)}
    assert not {r.vec_id for r in got} & {2_000, 2_020, 2_040, 2_060, 2_080}
    assert hnsw.search(hnsw.build(table.limit(0)), queries).collect() == []
    one = table.filter("vec_id = 7")
    assert hnsw.search(hnsw.build(one), one.withColumnRenamed("vec_id", "query_id")).collect() == []


def test_maxscore_query_skips_unusable_rows(spark, tmp_path):
    rows = [(0, [0.5, -0.25], 0), (1, [0.5, 0.5], 0), (2, [NAN, 1.0], 0), (3, None, 0), (4, [None, 1.0], 0), (50, [0.1, 0.1], 0)]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op2_maxscore(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1, 128 * 128 - 64 * 128), (0, 2, 50, 128 * 25 - 64 * 25), (50, 1, 1, 25 * 256), (50, 2, 0, 25 * 64)]


@pytest.mark.parametrize("method", ["maxscore", "hnsw"])
def test_repeated_query_rows_have_all_their_neighbours_each(spark, method):
    """Three equal rows of a query, and another vector under the same id."""
    draw = np.random.RandomState(4)
    points = draw.randint(-9, 10, size=(80, 6)).astype(float)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    asked = [rows[0]] * 3 + [(0, points[1].tolist()), rows[20]]
    if method == "maxscore":
        table, queries = (spark.createDataFrame(r, "key bigint, w array<double>").selectExpr(
            f"key AS {n}", "cast(w AS array<bigint>) AS weights") for r, n in ((rows, "vec_id"), (asked, "query_id")))
        got = maxscore.search(queries, table, 5, shard_rows=30, query_block=2).collect()
    else:
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
        got = hnsw.search(hnsw.build(table, shard_rows=30), queries, 5, query_block=2).collect()
    expected = [
        (key, n + 1, other, score) for key, point in asked
        for n, (other, score) in enumerate(ranked(points @ np.array(point), np.arange(80), key, 5))
    ]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_hnsw_finds_neighbours_in_clusters():
    """A third of the vectors in one of 60 tight clusters, which have no links out of them."""
    draw = np.random.RandomState(3)
    centres = draw.randn(60, 32)
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    which = np.where(draw.random_sample(4_000) < 1 / 3, 0, draw.randint(1, 60, size=4_000))
    points = centres[which] + 0.02 * draw.randn(4_000, 32)
    points /= np.linalg.norm(points, axis=1)[:, None]
    graph = hnsw.Graph(hnsw.build_shard(0, points, [np.array([i]) for i in range(4_000)]))
    asked = draw.choice(4_000, 400, replace=False)
    hits = []
    for own, places in zip(asked, graph.search(points[asked], hnsw.BEAM), strict=True):
        expected = {key for key, _ in ranked(points @ points[own], np.arange(4_000), own, 20)}
        hits.append(len(expected & set(places[places != own][:20].tolist())))
    assert min(hits) > 0 and sum(hits) / (20 * len(hits)) >= 0.99


def test_hnsw_gives_as_many_as_asked_for(spark):
    draw = np.random.RandomState(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(600, 8)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    query = table.filter("vec_id IN (0, 20)").withColumnRenamed("vec_id", "query_id")
    index = hnsw.build(table, k=300)
    points = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    for k in (150, 300):
        got = hnsw.search(index, query, k).collect()
        assert len(got) == 2 * k
        for own in (0, 20):
            exact = {i for i, _ in ranked(points @ points[own], np.arange(600), own, k)}
            assert len(exact & {r.vec_id for r in got if r.query_id == own}) >= 0.95 * k
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id bigint, embedding array<float>")
    asked = equal.filter("vec_id = 3").withColumnRenamed("vec_id", "query_id")
    got = sorted(hnsw.search(hnsw.build(equal, k=50), asked, 50).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in got] == [i for i in range(51) if i != 3]
    with pytest.raises(ValueError):
        hnsw.search(hnsw.build(equal), asked, 50)
