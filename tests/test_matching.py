import math
import random
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from hirelode.catalog import fixtures as fx
from hirelode.operators import matching, ranking

JOBS = [
    (1, "Python data, AWS", [1.0, 0.0], [1.0, 0.0]),
    (2, "", [0.0, 0.0], [0.6, 0.8]),
    (3, "SQL sql SQL", [1.0, 1.0], [0.0, 0.0]),
]
CVS = [(10, "python and sql", [1.0, 0.0]), (11, "", [0.0, 2.0])]
ROLES = [(0, "first", [1.0, 0.0]), (1, "same", [2.0, 0.0]), (2, "other", [0.0, 1.0])]


@pytest.fixture
def sides(spark):
    jobs = spark.createDataFrame(
        JOBS, "job_id int, description string, embedding array<float>, title_embedding array<float>"
    )
    cvs = spark.createDataFrame(CVS, "cv_id int, text string, embedding array<float>")
    roles = spark.createDataFrame(ROLES, "role_idx int, role string, embedding array<float>")
    return jobs, cvs, roles


@pytest.fixture
def offers(spark):
    return spark.createDataFrame([(j, r) for j in (1, 2, 3, 4, 5) for r in (0, 1, 2)], "job_id int, role_idx int")


def test_match_report(spark, sides, offers, plan):
    jobs, cvs, roles = sides
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "job_id int, cv_id int")
    report = matching.match_report(pairs, jobs, cvs, offers, roles)
    assert "Cartesian" not in plan(report) and "EvalPython" not in plan(report)
    got = {(r.job_id, r.cv_id): r for r in report.collect()}
    one = got[1, 10]
    assert one.semantic_similarity_percentage == 100.0
    assert one.keyword_match.matched_keywords == ["python"]
    assert one.keyword_match.missing_keywords == ["aws", "data"]
    assert one.keyword_match.match_percentage == 33.33
    assert one.title_match.best_role == "first" and one.title_match.title_matched
    assert one.overall_similarity_percentage == round(0.45 * 100 + 0.35 * 33.33 + 0.20 * 100, 2)
    assert got[1, 11].semantic_similarity_percentage == 0.0
    assert got[2, 10].keyword_match.total_keywords == 0
    assert got[2, 10].semantic_similarity_percentage == 0.0
    assert got[2, 10].title_match.best_role == "other"
    assert got[3, 10].semantic_similarity_percentage == round(100 / math.sqrt(2), 2)
    assert got[3, 10].title_match.best_role == "first" and not got[3, 10].title_match.title_matched
    top = matching.best_jobs_per_cv(report, 1).collect()
    assert {(r.cv_id, r.job_id) for r in top} == {(10, 1), (11, 1)}


def test_pairs_without_a_side_or_a_vector_are_reported(spark, sides, offers):
    jobs, cvs, roles = sides
    bare = spark.createDataFrame([(4, "python", None, None)], jobs.schema)
    pairs = spark.createDataFrame([(1, 10), (4, 10), (9, 10), (1, 99)], "job_id int, cv_id int")
    report = matching.match_report(pairs, jobs.union(bare), cvs, offers, roles)
    got = {(r.job_id, r.cv_id): r for r in report.collect()}
    assert len(got) == 4 and got[1, 10].overall_similarity_percentage is not None
    for pair in ((4, 10), (9, 10), (1, 99)):
        assert got[pair].semantic_similarity_percentage is None
        assert got[pair].overall_similarity_percentage is None
    assert got[4, 10].title_match is None and got[4, 10].keyword_match.matched_count == 1
    assert got[9, 10].keyword_match.total_keywords == 0
    assert got[1, 99].title_match.best_role == "first" and got[1, 99].keyword_match.matched_count == 0
    top = matching.best_jobs_per_cv(report, 3).filter("cv_id = 10").orderBy("rank").collect()
    assert [r.job_id for r in top] == [1, 4, 9]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(matching.cosine_pct("a", "b").alias("c")).collect()] == [96.0, 0.0, -100.0]


def test_a_cv_in_a_third_of_all_pairs(spark, sides):
    jobs, cvs, _ = sides
    pairs = spark.range(900).select(
        (F.col("id") % 3 + 1).cast("int").alias("job_id"),
        F.when(F.col("id") % 3 == 0, 10).otherwise(11).alias("cv_id"),
    )
    joined = matching.attach_pairs(pairs, matching.prepare_jobs(jobs), matching.prepare_cvs(cvs))
    assert joined.count() == 900


def test_a_posting_is_not_shuffled_for_each_of_its_pairs(spark, sides, plan):
    jobs, cvs, _ = sides
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (9, 10), (1, 99)], "job_id int, cv_id int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = matching.attach_pairs(pairs, matching.prepare_jobs(jobs), matching.prepare_cvs(cvs))
        nodes = plan(joined).splitlines()
        by_cv = [i for i, node in enumerate(nodes) if "Exchange hashpartitioning(cv_id" in node]
        assert len(by_cv) == 2
        for i in by_cv:
            depth = nodes[i].index("Exchange")
            deeper = takewhile(lambda node: not node[: depth + 1].strip(" :+-"), nodes[i + 1 :])
            assert not any("job_tokens" in node for node in deeper)
        got = {(r.job_id, r.cv_id): (r.job_tokens, r.cv_tokens) for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(got) == 5
    assert got[1, 10] == (["python", "data", "aws"], ["python", "and", "sql"])
    assert got[9, 10] == (None, ["python", "and", "sql"]) and got[1, 99] == (["python", "data", "aws"], None)


def test_best_postings_over_all_pairs_equal_the_full_product(spark, sides, offers):
    """Ties, equal postings, hot words, rows without a score, more CVs than a block holds."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    common = words[:40]

    def text(most):
        return " ".join(draw.choices(common, k=draw.randint(0, most)) + draw.choices(words, k=draw.randint(0, most)))

    def vector():
        return [draw.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]

    jobs = [(i, text(30), draw.choice([None, vector()]) if i % 9 == 0 else vector(), vector()) for i in range(150)]
    jobs += [(i, "w1 w2", [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]) for i in range(150, 200)] + [(200, None, vector(), None)]
    people = [(i, text(40), vector()) for i in range(25)] + [(25, None, [1.0, 0.0, 0.0, 0.0]), (26, "w1", None), (27, "w1 w2", [1.0, 0.0, 0.0, 0.0])]
    roles = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0, 0.0]), (1, "b", [0.0, 1.0, 0.0, 0.0])], "role_idx int, role string, embedding array<float>")
    jobs_df = spark.createDataFrame(jobs, sides[0].schema)
    cvs_df = spark.createDataFrame(people, sides[1].schema)
    held = jobs_df.filter("job_id % 7 <> 3").selectExpr("job_id", "explode(array(0, 1)) AS role_idx")
    pairs = spark.createDataFrame([(j[0], c[0]) for j in jobs for c in people], "job_id int, cv_id int")
    report = matching.match_report(pairs, jobs_df, cvs_df, held, roles)
    scored = report.filter("overall_similarity_percentage IS NOT NULL")
    for k in (1, 10, 500):
        wanted = matching.best_jobs_per_cv(scored, k).select("cv_id", "rank", "job_id", "overall_similarity_percentage")
        got = ranking.top_jobs_per_cv(jobs_df, cvs_df, held, roles, k)
        assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert ranking.top_jobs_per_cv(jobs_df.limit(0), cvs_df, held, roles).count() == 0
    assert ranking.top_jobs_per_cv(jobs_df, cvs_df.limit(0), held, roles).count() == 0
    # Blocks and shards of other sizes change nothing.
    postings, cvs = ranking.prepared(jobs_df, cvs_df, held, roles)
    cvs = cvs.withColumn("least", F.lit(None).cast("double"))
    small = ranking.bounded_pairs(postings, cvs, block=4, shard=16).drop("least")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, ranking.bounded_pairs(postings, cvs).drop("least").collect()))


def test_few_pairs_have_their_words_compared(spark):
    sf = "/root/testdata/sf0.01"
    postings, people = ranking.prepared(fx.jobs(spark, sf), fx.cvs(spark, sf), fx.offers(spark, sf), fx.roles(spark, sf))
    read = ranking.candidate_pairs(postings, people, 10).count()
    assert 400 <= read < 0.1 * postings.count() * people.count()
