"""Filter interaction audit: who removes what, in which order, and how much is a filter's own doing.

Each document is reduced to the set of filters it fails, and documents are counted by part and set. From
these counts the removals of all coalitions of filters are tabulated. What a step of an order removes is
the difference of two coalitions. A filter's fair share, its Shapley value, is the solution of a
least-squares problem over the coalitions, weighted by the Shapley kernel and held to the removals of
all filters together; its normal equations are solved in rational numbers, so the shares are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.session import materialize

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT, CAPITAL_PERCENT = 65, 5
# What lies between words, and the characters filter D looks for.
BETWEEN = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")
AUDIT = (
    "part string, filter_order string, step int, filter string, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def failures(df: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, digest, fails): per row the filters A to D that its text fails, as bits 0 to 3."""
    named = df.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    split = named.withColumn("words", F.array_remove(F.split("text", BETWEEN), ""))
    sized = split.select(
        "key", "part", "text", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct")
    )
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = (
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct").cast("long") < DISTINCT_PERCENT * F.col("words").cast("long"),
        100 * capitals.cast("long") > CAPITAL_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike(SIGNS),
    )
    bits = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(failed)), F.lit(0))
    return sized.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("fails"))


def repeated_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, first): texts that rows of several keys hold, with the smallest key."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest")
    held = df.select(F.col(f"`{key}`").alias("key"), digest).groupBy("digest").agg(
        F.min("key").alias("first"), F.max("key").alias("last")
    )
    return held.filter("first < last").drop("last")


def tabulate(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part that fail exactly the filters of a set.

    The set is a number with bit 0 for A up to bit 4 for E. A document fails E if a row of a smaller key
    has its text; rows without a key neither fail E nor make others fail it. Null texts are empty, null
    parts are the part ''. Good and toxic are documents with a label 1, of which any row of their key
    may have it. Repeated rows count each.
    """
    marks = failures(docs, key, text, part)
    # What is joined is written before, so that the documents' side is a plain shuffle: a text or key that a
    # third of the rows have makes a large partition, which the adaptive skew join can split.
    firsts = materialize(repeated_texts(docs, key, text))
    known = materialize(labels.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(
        F.max((F.col(f"`{quality}`") == 1).cast("int")).alias("good"),
        F.max((F.col(f"`{toxic}`") == 1).cast("int")).alias("toxic"),
    ).filter("good = 1 OR toxic = 1"))
    late = F.when(F.col("key") > F.col("first"), 1 << 4).otherwise(0)
    whole = marks.join(firsts, "digest", "left").select("key", "part", (F.col("fails") + late).alias("fails"))
    return whole.join(known, "key", "left").groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def coalition_removals(counts: Sequence[int], size: int) -> list[int]:
    """Of every coalition how many documents its filters remove: those whose set of failures meets it.

    A document stays if its failures lie in the complement, so sums over subsets tell all coalitions.
    """
    within = list(counts)
    for bit in range(size):
        for at in range(1 << size):
            if at >> bit & 1:
                within[at] += within[at ^ 1 << bit]
    every = (1 << size) - 1
    return [within[every] - within[every ^ coalition] for coalition in range(1 << size)]


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of linear equations in rational numbers, by elimination."""
    size = len(right)
    rows = [[*line, value] for line, value in zip(matrix, right, strict=True)]
    for at in range(size):
        pivot = next(i for i in range(at, size) if rows[i][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for i in range(size):
            if i != at and rows[i][at]:
                rows[i] = [x - rows[i][at] * y for x, y in zip(rows[i], rows[at], strict=True)]
    return [line[-1] for line in rows]


@cache
def kernel(size: int) -> tuple[list[Fraction], list[list[Fraction]]]:
    """Weights of the coalitions, and the matrix of the normal equations with the efficiency constraint.

    The empty coalition and that of all filters have no weight: they are held to exactly.
    """
    weights = [Fraction(0)] * (1 << size)
    for coalition in range(1, (1 << size) - 1):
        members = coalition.bit_count()
        weights[coalition] = Fraction(size - 1, comb(size, members) * members * (size - members))
    matrix = [
        [sum((w for c, w in enumerate(weights) if c >> i & c >> j & 1), Fraction(0)) for j in range(size)] + [Fraction(1)]
        for i in range(size)
    ]
    return weights, [*matrix, [Fraction(1)] * size + [Fraction(0)]]


def shapley_values(removals: Sequence[int], size: int) -> list[Fraction]:
    """The share of each filter: weighted least squares over all coalitions, adding up to all removals."""
    weights, matrix = kernel(size)
    right = [
        sum((w * removals[c] for c, w in enumerate(weights) if c >> i & 1), Fraction(0)) for i in range(size)
    ]
    return solved(matrix, [*right, Fraction(removals[-1])])[:size]


def audited(part: str, counts: dict[str, list[int]], names: str) -> list[tuple]:
    """Rows of the audit of one part, from its documents, good and toxic ones by set of failures."""
    size = len(names)
    removals = {kind: coalition_removals(values, size) for kind, values in counts.items()}
    every, orders = sum(counts["n"]), factorial(size)
    shares = [int(orders * value) for value in shapley_values(removals["n"], size)]
    fails = [removals["n"][1 << i] for i in range(size)]
    rows = []
    for order in permutations(range(size)):
        name, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (removals[kind][after] - removals[kind][before] for kind in COUNTS)
            rows.append((
                part, name, step, names[i], every - removals["n"][after], removed, fails[i] - removed,
                counts["n"][1 << i], good, toxic, shares[i],
            ))
            before = after
    return rows


def audit(table: DataFrame, names: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step what the step keeps, removes and loses.

    `table` is that of `tabulate`: (part, fails, n, good, toxic). Columns: part, filter_order, step, filter,
    kept, removed, redundant (failing the filter but gone before), unique_fails (failing it alone),
    good_lost, toxic_lost, and shapley: the filter's removals summed over all orders, an exact whole number.
    An empty table gives no rows. A part is one row of a count per set of failures, whatever its size.
    """
    sets = 1 << len(names)
    column = lambda kind: F.array(*[
        F.coalesce(F.sum(F.when(F.col("fails") == s, F.col(kind))), F.lit(0)) for s in range(sets)
    ]).alias(kind)
    parts = table.groupBy("part").agg(*[column(kind) for kind in COUNTS])
    schema = pa.schema([
        (c.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[c.split()[1]])
        for c in AUDIT.split(", ")
    ])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = audited(row["part"], {kind: row[kind] for kind in COUNTS}, names)
                columns = zip(schema, zip(*made, strict=True), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in columns], schema=schema)

    return parts.mapInArrow(run, AUDIT)
