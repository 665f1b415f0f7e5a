"""Tables laid out by key, and upserts into them."""

import pytest

from hirelode.sources import keyed

SCHEMA = "pos int, k string, t string, link string"
ROWS = [(1, "a", "x", " l1 "), (2, "a", "x", "l1"), (3, "a", "x", ""), (4, " a", "x", " "), (5, "b", "x", None)]


@pytest.fixture
def upsert(tmp_path):
    path = str(tmp_path / "table")

    def run(batch, number, **more):
        counts = keyed.upsert(batch, path, number, ["k", "t", "link"], "link", ["pos"], **more)
        rows = batch.sparkSession.read.parquet(path)
        return counts, sorted((r.run_id, r.pos) for r in rows.collect())

    return run


def test_a_run_that_is_run_again_gives_the_same_table_and_counts(spark, upsert):
    batch = spark.createDataFrame(ROWS, SCHEMA)
    first = upsert(batch, 1, buckets=4)
    assert first == ({"inserted": 3, "skipped": 2}, [(1, 1), (1, 3), (1, 5)])
    assert upsert(batch, 1) == first
    more = spark.createDataFrame([(9, "z", "q", "l9"), (10, "a", "x", "l1"), (11, "b", "x", "")], SCHEMA)
    second = upsert(more, 2)
    assert second == ({"inserted": 1, "skipped": 2}, [(1, 1), (1, 3), (1, 5), (2, 9)])
    assert upsert(more, 2) == second and upsert(batch, 1)[1] == second[1]
    assert upsert(batch, 3) == ({"inserted": 0, "skipped": 5}, second[1])
    assert upsert(batch.limit(0), 4) == ({"inserted": 0, "skipped": 0}, second[1])


def test_a_link_is_no_row_key(spark, upsert):
    batch = spark.createDataFrame([(1, "a", "b", 'row:["a","b",""]'), (2, "a", "b", ""), (3, 'a","b', "", "")], SCHEMA)
    assert upsert(batch, 1)[0] == {"inserted": 3, "skipped": 0}


def test_the_layout_a_table_was_made_with_stays(spark, tmp_path, upsert):
    batch = spark.createDataFrame([(i, f"k{i}", "t", f"l{i}") for i in range(200)], SCHEMA)
    upsert(batch, 1, buckets=8)
    spark.sql(f"DROP TABLE {keyed._name(str(tmp_path / 'table'))}")
    assert upsert(batch, 2, buckets=3)[0] == {"inserted": 0, "skipped": 200}
    with pytest.raises(ValueError):
        keyed.keyed_table(spark, str(tmp_path / "table"), batch.schema, "link")


def test_a_wide_batch_meets_the_buckets_in_place(spark, tmp_path, upsert):
    batch = spark.createDataFrame([(i, f"k{i}", "t", f"l{i % 70}") for i in range(300)], SCHEMA)
    assert upsert(batch, 1, buckets=4)[0] == {"inserted": 70, "skipped": 230}
    path = str(tmp_path / "table")
    stored = batch.select("*", keyed.stored_key(["k", "t", "link"], "link").alias("_key"))
    table = keyed.keyed_table(spark, path, stored.schema, "_key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = stored.join(keyed.other_runs(table, 2).select("_key"), "_key", "left_anti")
        text = new._jdf.queryExecution().executedPlan().toString()
        assert new.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1 and "Bucketed: true" in text and "PartitionFilters: [isnotnull(run_id" in text
