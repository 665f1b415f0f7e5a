"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from hirelode.operators.report import run_summary, zone_breakdown
from hirelode.catalog import oracle
from hirelode.catalog import queries as catalog
from tests.conftest import SMALL, TABLES

QUERIES, ORACLE = catalog.REGISTRY, oracle.ORACLE


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    assert got
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())


def test_entry_returns_the_breakdown(spark):
    assert entry_points.entry(spark).columns == ["location_zone", "postings", "zone_order"]


def test_breakdown_sums_to_the_summary(spark):
    run = catalog.triaged(spark, SMALL)
    summary = run_summary(run).first()
    zones = sum(r.postings for r in zone_breakdown(run).collect())
    assert zones == summary.high_relevant + summary.relevant
    assert summary.total == summary.high_relevant + summary.relevant + summary.non_relevant


@pytest.mark.parametrize("name", ["triage_postings", "website_contacts", "match_report", "pending_recipients"])
def test_plans_have_no_python_and_no_cross_join(spark, plan, name):
    text = plan(QUERIES[name](spark, SMALL))
    for operator in ("EvalPython", "InPandas", "InArrow", "Cartesian", "NestedLoopJoin"):
        assert operator not in text


def nodes(plan):
    """All operators of a physical plan, each with its output's column names."""
    yield plan, [plan.output().apply(i).name() for i in range(plan.output().size())]
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_triage_shuffles_the_descriptions_of_new_postings_only(spark):
    """With nothing broadcast but the filter: an exchange with descriptions has the filter below it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = QUERIES["triage_postings"](spark, SMALL)._jdf.queryExecution().executedPlan()
        exchanges = [
            (node, columns) for node, columns in nodes(executed)
            if node.nodeName() == "Exchange" and "hashpartitioning" in node.outputPartitioning().toString()
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    wide = [node for node, columns in exchanges if "description" in columns]
    assert len(wide) == 1
    assert any(n.nodeName() == "BroadcastHashJoin" and "_bits" in names for n, names in nodes(wide[0]))
    by_link = [c for node, c in exchanges if node.outputPartitioning().toString().startswith("hashpartitioning(apply_link")]
    assert len(by_link) == 2  # those of the postings, and those of the history
