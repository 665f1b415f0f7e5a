from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.session import scratch_path, shared_dir
from hirelode.sources import keys, rows, runs


def test_keys(spark, tmp_path):
    file = tmp_path / "keys.txt"
    file.write_text("﻿a.de\n\n  B.de  \nb.de\na.de\n", encoding="utf-8")
    assert {r.key for r in keys.read_keys(spark, str(file)).collect()} == {"a.de", "B.de", "b.de"}
    assert {r.key for r in keys.read_keys(spark, str(file), lower=True).collect()} == {"a.de", "b.de"}
    ordered = keys.read_recipients(spark, str(file)).orderBy("pos")
    assert [r.email for r in ordered.collect()] == ["a.de", "B.de", "b.de", "a.de"]


def test_missing_files_are_empty(spark, tmp_path):
    absent = str(tmp_path / "absent")
    assert keys.read_keys(spark, absent).count() == 0
    assert keys.read_recipients(spark, absent).count() == 0
    assert keys.read_clean_emails(spark, absent).count() == 0
    assert rows.read_history(spark, [absent]).count() == 0
    with pytest.raises(AnalysisException):
        rows.read_rows(spark, absent)


def test_recipients_keep_file_order_across_splits(spark, tmp_path):
    file = tmp_path / "many.txt"
    names = [f"p{i}@x.de" for i in range(3000)]
    file.write_text("\n".join(names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = keys.read_recipients(spark, str(file))
        assert read.rdd.getNumPartitions() > 1
        assert [r.email for r in read.orderBy("pos").collect()] == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sorted_keys_in_several_files(spark, tmp_path):
    path = str(tmp_path / "sorted")
    df = spark.createDataFrame([("b@firma.de",), ("A@firma.de",), ("b@firma.de",), ("info@x.js",), ("c@",)], "key string")
    keys.write_sorted_keys(df.withColumn("key", F.concat(F.lit("x"), "key")), path, emails=True)
    assert [r.value for r in spark.read.text(path).orderBy("value").collect()] == ["xa@firma.de", "xb@firma.de"]
    numbers = spark.range(1000).select(F.format_string("%05d", "id").alias("key"))
    keys.write_sorted_keys(numbers, str(tmp_path / "numbers"))
    parts = sorted((tmp_path / "numbers").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().split()]
    assert lines == sorted(lines) and len(lines) == 1000


def test_append_keys(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(" A@x.de ",)], "key string")
    keys.append_keys(df, path, lower=True)
    keys.append_keys(df, path, lower=True)
    assert [r.value for r in spark.read.text(path).collect()] == ["a@x.de", "a@x.de"]


def test_posting_rows_round_trip(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.createDataFrame([("a \"q\", b\nc", None), ("", "ü")], "`Job Title` string, Company string")
    rows.write_rows(df, path)
    back = rows.read_rows(spark, path)
    assert tuple(back.columns) == rules.POSTING_FIELDS
    assert {(r["Job Title"], r.Company, r.Keyword) for r in back.collect()} == {
        ("a \"q\", b\nc", None, None), (None, "ü", None),
    }


def test_rows_with_byte_order_mark_and_own_header(spark, tmp_path):
    file = tmp_path / "c.csv"
    file.write_text('﻿company,Career Page,n\nA,"x\ny",1\n', encoding="utf-8")
    back = rows.read_rows(spark, str(file))
    assert back.columns == ["company", "Career Page", "n"]
    assert back.first()["Career Page"] == "x\ny"


def test_history_over_files(spark, tmp_path):
    (tmp_path / "new.csv").write_text("Job Title,Keyword,Apply Link,Time Filter,Relevance\nA,k, l1 ,t,no\nB,k,,t,no\n")
    (tmp_path / "old.csv").write_text("Job Title,Keyword,Apply Link\nSoftware,k,l2\nX,k,l1\nSales,k,l3\nY,k,l2\n")
    paths = [str(tmp_path / n) for n in ("new.csv", "absent.csv", "old.csv")]
    got = {r["Apply Link"].strip(): r for r in rows.read_history(spark, paths).collect()}
    assert set(got) == {"l1", "l2", "l3"}
    assert (got["l1"]["Job Title"], got["l1"]["Time Filter"], got["l1"]["Relevance"]) == ("A", "t", "no")
    assert (got["l2"]["Job Title"], got["l2"]["Time Filter"], got["l2"]["Relevance"]) == ("Software", "Unknown", "yes")
    assert got["l3"]["Relevance"] == "no"


def test_runs(spark, tmp_path, plan):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([(1, "relevant"), (2, "non_relevant"), (3, "high_relevant")], "id int, relevance string")
    runs.write_run(df, path, datetime(2026, 4, 1, 9, 30))
    runs.write_run(df, path, datetime(2026, 4, 1, 9, 30))
    runs.write_run(df.filter("id = 1"), path, datetime(2026, 4, 1, 18, 0))
    runs.write_run(df, path, datetime(2026, 4, 2, 7, 0))
    read = runs.read_runs(spark, path)
    assert read.count() == 7
    latest = runs.latest_run(read, "2026-04-01")
    assert sorted((r.id, r.run_time) for r in latest.collect()) == [(1, "18-00"), (2, "09-30")]
    assert "PartitionFilters" in latest._jdf.queryExecution().executedPlan().toString()
    # No run on that day: the whole history.
    assert runs.latest_run(read, "2026-05-01").count() == 7


def test_retention_of_run_folders(spark, tmp_path):
    path, now = str(tmp_path / "runs"), datetime(2026, 4, 3, 9, 0)
    for day, hour, ids in ((1, 8, [1]), (2, 8, [2, 3]), (2, 20, [4]), (3, 8, [5, 6])):
        stamps = {2: "2026-04-02 08:00", 3: "2026-04-02 09:00", 4: "2026-04-02 20:00", 5: "2026-04-03 08:00", 6: None}
        rows = [(i, stamps.get(i, "2026-04-01 08:00"), "no") for i in ids]
        df = spark.createDataFrame(rows, "id int, at string, relevance string").withColumn("at", F.col("at").cast("timestamp"))
        runs.write_run(df, path, datetime(2026, 4, day, hour, 0))
    kept = runs.retained(runs.read_runs(spark, path), "at", now)
    assert sorted(r.id for r in kept.collect()) == [3, 4, 5]
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "2026-04-02" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert runs.drop_old_runs(spark, path, now) == ["2026-04-01"]
    assert sorted(r.id for r in runs.read_runs(spark, path).collect()) == [2, 3, 4, 5, 6]
    assert runs.drop_old_runs(spark, path, now) == [] and runs.drop_old_runs(spark, str(tmp_path / "none"), now) == []


def test_scratch_lies_in_the_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured
    assert scratch_path(spark, "x").startswith(configured)
