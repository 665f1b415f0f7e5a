"""Rules as a table against the expression form and against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions import classify
from hirelode.functions.text import fold_umlauts
from hirelode.operators import rule_tables

BOUNDS = [rule_tables.BROADCAST_BYTES, -1]


@pytest.mark.parametrize("bound", BOUNDS)
def test_zones_equal_the_expression(spark, bound):
    draw = random.Random(1)
    places = [p for _, tier in rules.ZONE_TIERS for p in tier]
    texts = [None, "", "Hessen", "Köln (Remote)", "BERLIN", "Nowhere", "x" * 50_000] + [
        " ".join(draw.choices(places, k=draw.randint(1, 3))).title().replace(" ", draw.choice([" ", "-", "", ", "])) for _ in range(300)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, location string")
    wanted = {r.key: r.zone for r in df.select("key", classify.location_zone("location").alias("zone")).collect()}
    folded = df.select("key", fold_umlauts("location").alias("text"))
    got = rule_tables.first_labels(folded, rule_tables.place_rules(spark, rules.ZONE_TIERS), rules.ZONE_DEFAULT, broadcast_bytes=bound)
    assert {r.key: r.label for r in got.collect()} == wanted and got.count() == len(texts)


@pytest.mark.parametrize("bound", BOUNDS)
def test_skills_equal_the_expression(spark, bound):
    draw = random.Random(2)
    pieces = ["Python", "sql", "MySQL", "data\u00a0science", "data", "engineering", "ETL", "künstliche Intelligenz", "KI", "skip", "power  BI", "powerbi",
              "google cloud", "AI.", "mail", "pandas", "Data Analytics", "analysis", "Größe"]
    texts = [None, "", " "] + [" ".join(draw.choices(pieces, k=draw.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, description string")
    skills = rules.CORE_SKILLS + rules.SUPPORTING_SKILLS
    wanted = {r.key: r.labels for r in df.select("key", classify.extract_skills("description").alias("labels")).collect()}
    lowered = df.select("key", F.lower(F.coalesce("description", F.lit(""))).alias("text"))
    got = rule_tables.all_labels(lowered, rule_tables.skill_rules(spark, skills), broadcast_bytes=bound)
    assert {r.key: r.labels for r in got.collect()} == wanted


@pytest.mark.parametrize("bound", BOUNDS)
def test_thousands_of_rules_equal_a_loop(spark, bound):
    draw = random.Random(3)
    spell = lambda n: "".join(draw.choices("abcdeé", k=n))
    table = []
    for i in range(4_000):
        word = draw.choice([spell(draw.randint(1, 9)), f"{spell(2)}-{spell(5)}", f"({spell(6)})"])
        pattern = draw.choice([None, None, rf"(?U)\b{re.escape(word)}", rf"(?U){re.escape(word)}\s"])
        table.append((i, f"l{i % 700}", word, pattern))
    texts = [" ".join(spell(draw.randint(1, 14)) for _ in range(draw.randint(0, 8))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    rules_df = spark.createDataFrame(table, rule_tables.RULES)
    got = {(r.key, r.rule) for r in rule_tables.matched_rules(df, rules_df, broadcast_bytes=bound).collect()}
    wanted = {
        (k, i) for k, text in enumerate(texts) for i, _, word, pattern in table
        if word in text and (pattern is None or re.search(pattern.removeprefix("(?U)"), text))
    }
    assert got == wanted


def test_no_rules_and_no_texts(spark):
    df = spark.createDataFrame([(1, "berlin")], "key int, text string")
    none = spark.createDataFrame([], rule_tables.RULES)
    assert [tuple(r) for r in rule_tables.first_labels(df, none, "Other").collect()] == [(1, "Other")]
    assert [r.labels for r in rule_tables.all_labels(df, none).collect()] == [[]]
    assert rule_tables.first_labels(df.limit(0), rule_tables.place_rules(spark, rules.ZONE_TIERS), "Other").count() == 0
    with pytest.raises(ValueError):
        rule_tables.matched_rules(df, spark.createDataFrame([(0, "l", "--", None)], rule_tables.RULES))
