import random

import pytest
from pyspark.sql import functions as F

from hirelode.operators import order, pages
from hirelode.session import materialize


def test_global_rank_equals_a_sort(spark):
    chance = random.Random(2)
    # A third of the rows agree in the leading column.
    rows = [(i, 0 if i % 3 == 0 else chance.randint(0, 9), chance.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, zone int, score double").repartition(5)
    ranked = order.global_rank(df, [F.col("zone"), F.col("score").desc(), F.col("id")])
    got = {r.id: r["rank"] for r in ranked.collect()}
    wanted = sorted(rows, key=lambda r: (r[1], -r[2], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(wanted)}


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_previous_value_equals_brute_force(spark, partitions):
    chance = random.Random(4)
    data = []
    for i in range(1500):
        group = "hot" if i % 3 == 0 else chance.choice(["a", "b", "long", None, f"g{i % 90}"])
        value = None if group == "long" and i > 20 else chance.choice([None, None, f"v{i}"])
        data.append((group, i // 2, i, value))
    df = spark.createDataFrame(data, "g string, t int, id int, v string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = order.previous_value(df, ["g"], ["t", "id"], "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, wanted = {}, {}
    for g, _, i, v in data:
        wanted[i] = last.get(g)
        last[g] = v if v is not None else last.get(g)
    assert len(rows) == len(data) and {r.id: r.previous for r in rows} == wanted
    assert order.previous_value(df.limit(0), ["g"], ["t", "id"], "v").count() == 0


def test_a_hot_group_is_spread_over_many_tasks(spark, monkeypatch):
    df = spark.range(9_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "id AS t", "cast(id AS string) AS v")
    seen = []
    monkeypatch.setattr(order, "materialize", lambda placed: seen.append(materialize(placed)) or seen[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert order.previous_value(df, ["g"], ["t"], "v").count() == 9_000
        sizes = [r["count"] for r in seen[0].filter("g = 'hot'").groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3_000 and len(sizes) >= 8 and max(sizes) < 600


def test_repeated_redirect(spark):
    link = "https://www.google.com/url?q="
    rows = [(1, link + "a"), (2, None), (3, link + "a"), (4, ""), (5, link + "b"), (6, "https://x.de"), (7, link + "b"), (8, link + "b")]
    df = spark.createDataFrame(rows, "idx int, raw_url string").withColumn("search", F.lit(1))
    got = pages.repeated_redirect(df, ["search"], ["idx"])
    assert {r.idx for r in got.collect() if r.repeated} == {3, 8}


def test_caps(spark, plan):
    df = spark.range(2000).selectExpr("concat('u', id) AS profile_url", "cast(id % 5 + 1 AS int) AS page_num")
    capped = order.session_cap(df, 500)
    assert "TakeOrderedAndProject" in plan(capped)
    assert [r.profile_url for r in capped.limit(2).collect()] == ["u0", "u1"]
    assert order.page_cap(df, 3).agg(F.max("page_num")).first()[0] == 3
