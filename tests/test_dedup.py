import random

import pytest
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.operators import dedup, joins
from hirelode.plans.triage import triage

ROWS = 600


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some have none."""
    chance = random.Random(1)
    rows = []
    for i in range(ROWS):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{chance.randint(0, 80)}"
        rows.append((i, key, chance.randint(0, 4), chance.randint(1, 3), chance.randint(0, 24)))
    schema = "posting_id int, apply_link string, keyword_idx int, page_num int, card_idx int"
    return spark.createDataFrame(rows, schema).repartition(6), rows


def test_first_per_key_equals_brute_force(skewed, plan):
    df, rows = skewed
    best = {}
    for row in rows:
        order = (*row[2:], row[0])
        if row[1] not in best or order < best[row[1]][0]:
            best[row[1]] = (order, row[0])
    first = dedup.first_per_key(df, ["apply_link"])
    assert {(r.apply_link, r.posting_id) for r in first.collect()} == {
        (k, v[1]) for k, v in best.items()
    }
    text = plan(first)
    # One row per key and task reaches the shuffle.
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_a_hot_key_is_split_by_the_adaptive_join(skewed, spark, how):
    """The operators rely on it: no row is lost, and the hot partition is read in several pieces."""
    df, _ = skewed
    wide = df.withColumn("more", F.repeat(F.sha2(F.col("posting_id").cast("string"), 256), 20))
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "apply_link string, v int")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        joined = wide.repartition(12).join(right, "apply_link", how)
        rows = joined.collect()
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert "skew=true" in text
    kept = df.filter("apply_link NOT IN ('hot', 'k1') OR apply_link IS NULL").count() if how == "left_anti" else df.count()
    assert len(rows) == kept



def test_unseen_drops_blank_and_known_keys(skewed, spark):
    df, rows = skewed
    seen = spark.createDataFrame([(" k1 ",), ("k2",), ("k2",), ("",), (None,)], "apply_link string")
    got = dedup.unseen(df, seen, "apply_link").collect()
    assert {r.posting_id for r in got} == {r[0] for r in rows if r[1] not in (None, "k1", "k2")}


def test_insert_twice_adds_nothing(spark):
    rows = [(1, "a", "x", " l1 "), (2, "a", "x", "l1"), (3, "a", "x", ""), (4, " a", "x", " "), (5, "b", "x", None)]
    batch = spark.createDataFrame(rows, "pos int, k string, t string, link string")
    columns = ["k", "t", "link"]
    none = batch.limit(0)
    new = dedup.insert_if_absent(none, batch, columns, "link", ["pos"])
    assert sorted(r.pos for r in new.collect()) == [1, 3, 5]
    assert tuple(dedup.upsert_counts(batch, new).first()) == (3, 2)
    again = dedup.insert_if_absent(new, batch, columns, "link", ["pos"])
    assert again.count() == 0


def test_header_row_goes_only_if_equal(spark):
    header = ["A", "B"]
    rows = [(0, ["A ", " B", "x"]), (1, ["A", "B"]), (2, ["1", "2"])]
    df = spark.createDataFrame(rows, "pos int, cells array<string>")
    assert [r.pos for r in dedup.drop_header_row(df, header).collect()] == [1, 2]
    other = spark.createDataFrame([(0, ["A", "C"])], "pos int, cells array<string>")
    assert dedup.drop_header_row(other, header).count() == 1


def test_unique_keywords(spark):
    rows = [(0, "DevOps ", "devops"), (1, "Data", "data"), (2, " data", "data"), (3, " ", "data"), (4, "DATA", "devops")]
    df = spark.createDataFrame(rows, "pos int, keyword string, mode string")
    got = lambda mode: sorted(r.pos for r in dedup.unique_keywords(df, mode).collect())
    assert got("data") == [1] and got("devops") == [0, 4]
    assert got("both") == got("unknown") == [0, 1]


def test_search_keywords_per_run_mode(spark):
    lists = [(k, "data") for k in rules.DATA_KEYWORDS] + [(k, "devops") for k in rules.DEVOPS_KEYWORDS]
    rows = [(pos, keyword, mode) for pos, (keyword, mode) in enumerate(lists)]
    df = spark.createDataFrame(rows, "pos int, keyword string, mode string")
    sizes = [dedup.unique_keywords(df, mode).count() for mode in ("data", "devops", "both")]
    assert sizes == [31, 29, 60]


def test_new_domains_keeps_listings_without_a_website(spark):
    rows = [(1, "a.de"), (2, "a.de"), (3, None), (4, None), (5, "b.de"), (6, "")]
    listings = spark.createDataFrame(rows, "listing_idx int, domain string")
    tracked = spark.createDataFrame([("b.de",), ("b.de",)], "domain string")
    assert sorted(r.listing_idx for r in dedup.new_domains(listings, tracked).collect()) == [1, 3, 4, 6]


def test_pending_recipients(spark):
    people = spark.createDataFrame([(1, "A@x.de"), (2, "a@x.de"), (3, "B@x.de"), (4, "b@x.de")], "pos int, email string")
    sent = spark.createDataFrame([(" a@X.de ",), ("c@x.de",), ("",)], "email string")
    assert sorted(r.pos for r in joins.pending_recipients(people, sent).collect()) == [3, 4]
    assert [tuple(r) for r in joins.pending_recipients(people, sent, distinct=True).collect()] == [("B@x.de", 3)]
    assert tuple(joins.recipient_counts(people, sent).first()) == (4, 1, 2)


def test_fill_from_lookup(spark):
    rows = [("Google", " ", "1"), ("B", "", "2"), ("C", " x ", "3"), ("", "", "4"), (None, None, "5"), ("D", None, "6")]
    companies = spark.createDataFrame(rows, "company string, `Career Page` string, n string")
    careers = spark.createDataFrame([("B", "b/jobs"), ("B", "c/jobs"), ("", "no")], "company string, career_page string")
    got = joins.fill_from_lookup(companies, careers, prefilled={"Google": "g/jobs"})
    assert got.columns == companies.columns
    assert {r.n: r["Career Page"] for r in got.collect()} == {
        "1": "g/jobs", "2": "b/jobs", "3": " x ", "4": "", "5": None, "6": "",
    }


def test_history_join_reuses_the_partitioning_of_first_per_key(skewed, spark, plan):
    df, _ = skewed
    rows = df.filter("apply_link IS NOT NULL")
    seen = spark.createDataFrame([("k1",)], "apply_link string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = dedup.first_per_key(rows, ["apply_link"])
        text = plan(dedup.unseen(first, seen, "apply_link", unique=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One shuffle of the rows, one of the distinct known keys, none between the two operators.
    assert text.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_triage_keeps_null_positions_and_one_row_of_repeated_ones(spark, broadcast):
    rows = [
        (1, "l1", None, 1, 1, "a"), (2, "l1", 0, 1, 1, "b"), (3, "l2", 0, 1, 1, "c"), (3, "l2", 0, 1, 1, "c"),
        (None, "l3", 0, None, None, "d"), (None, "l3", 0, None, None, "d"), (4, "l4", 0, 1, 1, "e"), (4, "l4", 0, 1, 1, "f"),
        (5, "known", None, 1, 1, "g"), (6, None, 0, 1, 1, "h"),
    ]
    schema = "posting_id int, apply_link string, keyword_idx int, page_num int, card_idx int, title string"
    postings = spark.createDataFrame(rows, schema).selectExpr("*", "title AS company", "'Berlin' AS location", "'SQL' AS description")
    history = spark.createDataFrame([("known",)], "apply_link string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = [sorted((r.apply_link, r.posting_id, r.title) for r in triage(p, history).collect())
                 for p in (postings, postings.orderBy(F.desc("title")))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1]
    assert [r[:2] for r in found[0]] == [("l1", 1), ("l2", 3), ("l3", None), ("l4", 4)]


def test_membership_filter_loses_no_row(spark):
    df = spark.range(4_000).select(F.struct(F.when(F.col("id") % 7 > 0, F.col("id")).alias("a"), F.lit("x").alias("b")).alias("k"), "id")
    keys = df.filter("id % 40 = 0").select("k")
    wanted = {r.id for r in df.join(keys.distinct(), "k", "left_semi").collect()}
    for words in (1, 64, 1 << 20):
        got = joins.may_be_in(df, keys, "k", words)
        assert got.columns == df.columns
        kept = {r.id for r in got.collect()}
        assert wanted <= kept
    assert len(kept) < len(wanted) + 20
    assert joins.may_be_in(df, keys.limit(0), "k").count() == 0
