"""Rules as a table, for dictionaries of thousands of entries, which no expression holds.

A rule is a row: its place in the order of rules, its label, a word that any match contains, and a pattern
that decides, or none if the word does. The words of a text are cut into runs of a few characters, and so
is the beginning of each rule's word; texts and rules are joined on these, and what meets is checked
against the whole text. The first rule of a text is a combining minimum.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode.functions.classify import Skill
from hirelode.functions.text import UNICODE
from hirelode.session import materialize

RULES = "rule int, label string, word string, pattern string"
GRAM = 4
#: A rule table up to this size is sent to every task; beyond it texts and rules are both shuffled.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
BETWEEN = r"[^\p{L}\p{N}]+"


def place_rules(spark: SparkSession, tiers: Iterable[tuple[str, Sequence[str]]]) -> DataFrame:
    """Tiers of places as rules: a place is found wherever it occurs."""
    rows = [(label, place) for label, places in tiers for place in places]
    return spark.createDataFrame([(i, label, place, None) for i, (label, place) in enumerate(rows)], RULES)


def skill_rules(spark: SparkSession, skills: Iterable[Skill]) -> DataFrame:
    """A dictionary of skills as rules: a rule for each pattern, read as `functions.classify` reads it."""
    rows = [(label, word, UNICODE + pattern) for label, patterns, words in skills for pattern, word in zip(patterns, words, strict=True)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], RULES)


def _lead(word: str) -> Column:
    """The longest run of letters and digits of a rule's word, the first of several."""
    runs = F.split(word, BETWEEN)
    return F.reduce(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))


def _indexed(rules: DataFrame, gram: int) -> tuple[DataFrame, list[int], int]:
    """The rules with the run of characters they are looked up by, the lengths in use, and the table's size."""
    led = rules.select("rule", "label", "word", "pattern", F.substring(_lead("word"), 1, gram).alias("gram"))
    table = materialize(led)
    size = F.length("gram")
    stats = table.agg(
        F.collect_set(size).alias("sizes"),
        F.coalesce(F.sum(F.octet_length("word") + F.coalesce(F.octet_length("pattern"), F.lit(0)) + F.octet_length("label") + ROW_BYTES), F.lit(0)).alias("bytes"),
    ).first()
    if 0 in stats.sizes:
        raise ValueError("the word of a rule needs a letter or digit")
    return table, sorted(stats.sizes), stats.bytes


def _grams(texts: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """The distinct runs of characters of each text's words, with the columns to keep."""
    words = texts.select(*keep, F.explode(F.array_distinct(F.split("text", BETWEEN))).alias("word"))
    starts = F.sequence(F.lit(1), F.length("word"))
    placed = words.filter(F.length("word") > 0).select(*keep, "word", F.explode(starts).alias("at"))
    cut = [
        F.when(F.col("at") + size - 1 <= F.length("word"), F.substring("word", F.col("at"), F.lit(size))) for size in sizes
    ]
    if len(cut) == 1:
        return placed.select(*keep, cut[0].alias("gram")).filter("gram IS NOT NULL")
    return placed.select(*keep, F.explode(F.array_compact(F.array(*cut))).alias("gram"))


def matched_rules(
    texts: DataFrame, rules: DataFrame, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(key, rule, label): the rules that match, once per key, of a table (key, text) of distinct keys.

    Texts are folded by the caller, as the words and patterns of the rules are. A null or empty text
    matches nothing; so does everything without rules.
    """
    table, sizes, size = _indexed(rules, gram)
    named = texts.select("key", "text").filter(F.length("text") > 0)
    if not sizes:
        empty = F.lit(None).cast("int").alias("rule"), F.lit(None).cast("string").alias("label")
        return named.select("key", *empty).limit(0)
    if size <= broadcast_bytes:
        met = _grams(named, sizes, "key", "text").join(F.broadcast(table), "gram")
    else:
        # Only keys and runs are shuffled for the rules, and texts once for what meets.
        pairs = _grams(named, sizes, "key").distinct().join(table, "gram")
        met = pairs.drop("gram").distinct().join(named, "key")
    found = F.contains("text", "word") & (
        F.col("pattern").isNull() | F.expr("text RLIKE pattern")
    )
    return met.filter(found).select("key", "rule", "label").distinct()


def first_labels(texts: DataFrame, rules: DataFrame, default: str, **options) -> DataFrame:
    """(key, label) of every key: the label of the first rule that matches, else the default."""
    first = matched_rules(texts, rules, **options).groupBy("key").agg(
        F.min(F.struct("rule", "label")).alias("first")
    )
    return texts.select("key").join(first, "key", "left").select(
        "key", F.coalesce("first.label", F.lit(default)).alias("label")
    )


def all_labels(texts: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """(key, labels) of every key: the distinct labels of the rules that match, in order of the rules."""
    each = matched_rules(texts, rules, **options).groupBy("key", "label").agg(F.min("rule").alias("rule"))
    listed = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rule", "label"))).alias("found"))
    none = F.array().cast("array<string>")
    return texts.select("key").join(listed, "key", "left").select(
        "key", F.coalesce(F.col("found.label"), none).alias("labels")
    )

