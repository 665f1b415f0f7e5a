from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirelode.catalog import fixtures as fx
from hirelode.operators import report
from hirelode.plans.triage import triage
from hirelode.streaming.dedup import stream_dedup, stream_first_seen, within_retention
from hirelode.streaming.triage import batch_plan, stream_triage, triage_batch
from tests.conftest import SMALL


def stream_of(spark, rows, path, slices):
    for i in range(slices):
        rows.filter(F.col("posting_id") % slices == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("slices", [1, 3])
def test_any_slicing_finds_the_links_of_the_batch(spark, tmp_path, slices):
    rows = fx.new_postings(spark, SMALL)
    target = str(tmp_path / "target")
    stream = stream_of(spark, rows, str(tmp_path / "in"), slices)
    stream_triage(stream, target, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(target)
    nothing = spark.createDataFrame([], "apply_link string")
    wanted = triage(rows, nothing)
    links = lambda df: sorted(r.apply_link for r in df.select("apply_link").collect())
    assert links(got) == links(wanted)
    assert got.select("batch_id").distinct().count() == slices

    before = sorted(map(str, got.collect()))
    last = rows.filter(F.col("posting_id") % slices == slices - 1)
    triage_batch(last, slices - 1, target)
    assert sorted(map(str, spark.read.parquet(target).collect())) == before


def test_retention(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, timestamp '2026-01-02 12:00:00'),
        (2, timestamp '2026-01-01 12:00:00'), (3, timestamp '2026-01-01 11:59:59'),
        (4, timestamp '2026-02-01 00:00:00'), (5, CAST(NULL AS timestamp)) AS t(id, at)""")
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    assert sorted(r.id for r in within_retention(df, "at", now).collect()) == [1, 2, 4]


def test_stream_dedup_inside_one_window(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES ('a', timestamp '2026-01-01 00:00:00'),
        ('a', timestamp '2026-01-01 05:00:00'), ('b', timestamp '2026-01-01 06:00:00') AS t(k, at)""")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(source)
    rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream_dedup(stream, ["k"], "at").writeStream.format("parquet").option("path", target)
    run = run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == ["a", "b"]


@pytest.mark.parametrize("slices", [1, 4, 8])
def test_stream_dedup_does_not_depend_on_the_slices(spark, tmp_path, slices):
    rows = spark.sql("""SELECT concat('k', id % 5) AS k, id % 40 AS part,
        timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, id % 40, id % 24) AS at FROM range(400)""")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(slices):
        part = rows.filter(F.floor(F.col("part") * slices / 40) == i)
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run = stream_dedup(stream, ["k"], "at", lateness="40 days").writeStream.format("parquet")
        run = run.option("path", target).option("checkpointLocation", str(tmp_path / "state"))
        run.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, r.window_start) for r in spark.read.parquet(target).collect())
    wanted = rows.select("k", F.date_trunc("day", "at").alias("day")).distinct().collect()
    assert got == sorted((r.k, r.day) for r in wanted)


def run_slices(spark, folder, slices, start):
    """Each slice of (k, at) is a run of the stream; returns what all of them wrote."""
    source, target, state = (str(folder / name) for name in ("in", "out", "state"))
    schema = "k string, at string"
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run = start(stream).writeStream.format("parquet").option("path", target)
        run.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.k, str(r.at)[:16]) for r in spark.read.parquet(target).collect())


def test_a_key_on_both_sides_of_midnight_comes_out_once(spark, tmp_path):
    slices = [[("a", "2026-01-01 23:59:00")], [("a", "2026-01-02 00:01:00"), ("b", "2026-01-02 00:01:00")]]
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    first = run_slices(spark, tmp_path / "x", slices, lambda s: stream_first_seen(s, ["k"], "at"))
    assert first == [("a", "2026-01-01 23:59"), ("b", "2026-01-02 00:01")]
    windows = run_slices(spark, tmp_path / "y", slices, lambda s: stream_dedup(s, ["k"], "at"))
    assert [k for k, _ in windows] == ["a", "a", "b"]


def expiring(slices, hours=24):
    """The rule by hand: a key is known until the watermark of earlier slices has passed its row by `hours`."""
    known, latest, out = {}, None, []
    for rows in slices:
        times = [(k, datetime.fromisoformat(t)) for k, t in rows if t]
        mark = latest - timedelta(hours=hours) if latest else datetime.min
        known = {k: t for k, t in known.items() if t + timedelta(hours=hours) > mark}
        for k, t in times:
            if t > mark and k not in known:
                known[k] = t
                out.append((k, str(t)[:16]))
        latest = max([latest or datetime.min, *(t for _, t in times)])
    return sorted(out)


def test_expired_keys_come_out_again_as_stated(spark, tmp_path):
    slices = [
        [("a", "2026-01-01 10:00:00"), ("b", None)],
        [("a", "2026-01-02 09:00:00"), ("c", "2026-01-02 11:00:00")],
        [("a", "2026-01-03 11:00:00"), ("c", "2026-01-03 20:00:00")],
        [("a", "2026-01-04 12:00:00"), ("late", "2026-01-01 00:00:00"), ("b", "2026-01-03 12:00:00")],
        [("a", "2026-01-04 13:00:00"), ("c", "2026-01-06 00:00:00")],
        [("b", "2026-01-06 01:00:00"), ("c", "2026-01-06 02:00:00")],
    ]
    got = run_slices(spark, tmp_path, slices, lambda s: stream_first_seen(s, ["k"], "at"))
    assert got == expiring(slices)
    assert [k for k, _ in got].count("a") == 2


def test_history_of_a_batch_is_not_shuffled(spark, tmp_path, plan):
    rows = fx.new_postings(spark, SMALL)
    target = str(tmp_path / "target")
    triage_batch(rows.filter("posting_id % 2 = 0"), 0, target, buckets=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # As many partitions as a shuffle would make, fewer and more than the buckets are.
        for partitions in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            text = plan(batch_plan(rows, 1, target)[1])
            for part in text.split("Bucketed: true")[:-1]:
                above = part.rsplit("LeftAnti", 1)[1].splitlines()
                side = next(i for i, line in reversed(list(enumerate(above))) if "+- *" in line and "Sort [apply_link" in line)
                assert not any("Exchange" in line for line in above[side:])
            assert "Bucketed: true" in text
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    triage_batch(rows, 1, target)
    links = [r.apply_link for r in spark.read.parquet(target).collect()]
    assert len(links) == len(set(links)) == triage(rows, rows.select("apply_link").limit(0)).count()


def test_merged_summaries_equal_that_of_all_batches(spark, tmp_path):
    rows = fx.new_postings(spark, SMALL)
    target, partials = str(tmp_path / "target"), str(tmp_path / "summaries")
    stream = stream_of(spark, rows, str(tmp_path / "in"), 3)
    stream_triage(stream, target, str(tmp_path / "state"), summaries=partials).awaitTermination()
    triage_batch(rows.filter("posting_id % 3 = 2"), 2, target, summaries=partials)
    everything = spark.read.parquet(target)
    stored = spark.read.parquet(partials)
    assert stored.select("run_id").distinct().count() == 3
    assert report.merged_run_summary(stored).collect() == report.run_summary(everything).collect()
    assert report.merged_zone_breakdown(stored).collect() == report.zone_breakdown(everything).collect()
    assert report.merged_run_summary(stored.limit(0)).collect() == report.run_summary(everything.limit(0)).collect()
    visits = spark.createDataFrame([(i, s) for i, s in enumerate(["connect", "follow", "visited_only", "x", "connect"] * 7)], "run int, status string")
    parts = report.visits_per_status(visits.filter("run < 9")).unionAll(report.visits_per_status(visits.filter("run >= 9")))
    assert report.merged_visit_totals(parts).collect() == report.visit_totals(visits).collect()
