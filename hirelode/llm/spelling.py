"""Spelling variants by permuterm rotations.

A word with a terminator behind it is turned round until the character an edit touches comes last. All
words that agree up to that last character then stand next to each other when rotations are sorted:
those that end in different characters are replacements of one another, and the word that has nothing
there, turned round in the same way, is what remains when the character is deleted. So a prefix
that skips the edited character is one range of the sorted rotations, and all words of a range are
near to each other. A range holds one word for each character of the alphabet at most, and is scanned
without making pairs: the count and the two most frequent words tell each of its words all it needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.session import materialize

TERMINATOR = "\x00"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# What lies between runs of letters.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(run: Column, key: Column, every: int) -> Column:
    """The run, or for one in `every` of (key, run) the run without one of its characters."""
    h = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), run))
    at = (h % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, without).otherwise(run)


def word_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, slip_every: int | None = None,
) -> DataFrame:
    """(word, n): runs of letters of all whole texts, A-Z lower-cased, of enough characters and occurrences.

    With `slip_every`, one in so many distinct (key, run) loses a character, chosen by a checksum; a null
    key counts as the empty text there. Null texts have no words, repeated rows count each. Words are
    counted in each task before they are shuffled, so one in a third of all rows is a row per task.
    """
    runs = F.split(F.col(f"`{text}`"), BETWEEN)
    each = df.select(F.col(f"`{key}`").alias("key"), F.explode(runs).alias("run"))
    long = each.filter(F.length("run") >= least_length).select(
        "key", F.translate("run", LARGE, SMALL).alias("run")
    )
    word = F.col("run") if slip_every is None else slipped(F.col("run"), F.col("key"), slip_every)
    words = long.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, once, n): the rotations of every word, cut ahead of the character that is skipped.

    One for each character, which is `last`, and one for each gap between characters, with nothing last.
    `once` marks the first of a run of equal characters: deleting any of them gives the same word.
    """
    at = F.col("at")
    rest = F.substring("word", at + 2, F.length("word"))
    head = F.substring("word", F.lit(1), at)
    last = F.substring("word", at + 1, F.lit(1))
    edited = F.struct(
        F.concat(rest, F.lit(TERMINATOR), head).alias("prefix"), last.alias("last"),
        ((at == 0) | (F.substring("word", at, F.lit(1)) != last)).alias("once"),
    )
    whole = F.struct(
        F.concat(last, rest, F.lit(TERMINATOR), head).alias("prefix"), F.lit("").alias("last"), F.lit(False).alias("once")
    )
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    both = F.when(at < F.length("word"), F.array(edited, whole)).otherwise(F.array(whole))
    return places.select("n", F.explode(both).alias("r")).select("r.prefix", "r.last", "r.once", "n")


def scanned(turned: DataFrame) -> DataFrame:
    """(word, near, best_n, best): what each range of the sorted rotations says about each of its words.

    `near` counts neighbours such that the sum over a word's ranges counts each of them once: a
    replacement shares one range, a deletion counts where its character is the first of a run.
    """
    parts = F.split(F.concat("prefix", "last"), TERMINATOR)
    spelled = turned.withColumn("word", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
    group = Window.partitionBy("prefix")
    order = group.orderBy(F.desc("n"), "word")
    edits = F.count_if(F.col("last") != "").over(group)
    firsts = F.count_if(F.col("once")).over(group)
    size = F.count("*").over(group)
    here = F.struct("n", "word")
    other = F.when(F.row_number().over(order) == 1, F.lead(here).over(order)).otherwise(F.first(here).over(order))
    held = spelled.select("word", "last", "once", edits.alias("edits"), firsts.alias("firsts"), size.alias("size"), other.alias("other"))
    deleted = F.when(F.col("once"), F.col("size") - F.col("edits")).otherwise(0)
    near = F.when(F.col("last") == "", F.col("firsts")).otherwise(F.col("edits") - 1 + deleted)
    return held.filter("size > 1").select(
        "word", near.alias("near"), F.col("other.n").alias("best_n"), F.col("other.word").alias("best")
    )


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near) of every word of a written table (word, n) of distinct words.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form is
    the near word of the largest n, ties to the smaller one, if that n is at least `ratio` times the word's own.
    """
    found = scanned(rotations(words)).select("word", "near", F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")).alias("other"))
    none = F.lit(None).cast("struct<n:bigint,word:string>")
    every = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("other"))
    merged = every.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("other").alias("other")
    )
    good = -F.col("other.n") >= ratio * F.col("n")
    return merged.select(
        "word", "n", F.when(good, F.col("other.word")).alias("form"), F.when(good, -F.col("other.n")).alias("form_n"),
        "n_near",
    )


def with_roots(formed: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Append root: the last word that following forms reaches; a word without a form is its own.

    Every form is `ratio` times as frequent as the word before it, so a chain is no longer than the
    logarithm of the largest count; each round of joins doubles the steps taken.
    """
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    ends = formed.agg(F.max("n"), F.min("n")).first()
    steps = math.log(ends[0] / ends[1], ratio) + 1 if ends[0] else 1
    for _ in range(math.ceil(math.log2(max(steps, 1))) + 1):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(
            links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        )
    rooted = formed.join(links, "word", "left")
    return rooted.withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, word: str = "word", n: str = "n", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of a table of words and their counts.

    Counts of repeated words add up. Words that are null or hold the terminator, and null counts, take no
    part; the empty word is a word like any other. Other columns are not looked at; an empty table gives
    no rows. The ratio must be over 1, else forms could run in circles.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    usable = words.select(F.col(f"`{word}`").alias("word"), F.col(f"`{n}`").cast("long").alias("n")).filter(
        F.col("n").isNotNull() & (F.col("n") > 0) & ~F.contains(F.col("word"), F.lit(TERMINATOR))
    )
    counted = materialize(usable.groupBy("word").agg(F.sum("n").alias("n")))
    formed = materialize(forms(counted, ratio))
    return with_roots(formed, ratio).select("word", "form", "root", "n", "n_near", "form_n")
