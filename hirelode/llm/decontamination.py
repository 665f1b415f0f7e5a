"""Benchmark decontamination by a prefix-filtered set join.

A window is a fixed number of consecutive words of an item; an item of fewer words is one window. The
set of a window is that of its word shingles, ordered by how rare they are in the documents. As every
shingle of a window must be found, its prefix is one shingle, the rarest: documents and windows are
joined on that alone, and windows with a shingle that no document holds meet nothing. The place of the
shingle in the window and in the document bounds where the window can begin and whether it still
fits; what keeps the bounds is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.session import materialize

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: A table of shingles is broadcast up to this many bytes of rows, and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 96
# What lies between words once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The words of a whole text with A-Z lower-cased; null has none."""
    small = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), LARGE, SMALL)
    return F.array_remove(F.split(small, BETWEEN), "")


def token(words: Column, at: Column, size: int) -> Column:
    """Hash of the `size` words from place `at` on."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item, piece, window, n): every distinct window of every item; `piece` is its words in one string."""
    named = items.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("item"), words_of(text).alias("words")
    ).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    placed = named.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = F.slice("words", F.col("at") + 1, F.least(F.size("words"), F.lit(window)))
    made = placed.select("item", cut.alias("window"))
    return made.select(
        "item", F.array_join("window", " ").alias("piece"), "window", F.size("window").alias("n")
    ).distinct()


def window_tokens(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """(token, piece, window, n, offset): every shingle of every distinct window."""
    made = None
    for size in sizes:
        fit = windows.filter(F.least("n", F.lit(shingle)) == size)
        places = fit.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset"))
        part = places.withColumn("token", token(F.col("window"), F.col("offset"), size))
        made = part if made is None else made.union(part)
    return made


def spots(df: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(rid, words, n_words, pos, token): every shingle of every document, and one row at place -1.

    `rid` tells rows apart by key and text. The words are not copied as long as the next operators run
    in the same stage.
    """
    column = F.col(f"`{text}`")
    rid = F.struct(
        F.col(f"`{key}`").alias("key"), F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(1), column).alias("h2")
    )
    read = df.select(rid.alias("rid"), words_of(text).alias("words"))
    # Outer, as Spark would else split every text once more to see whether there is anything to explode.
    places = F.explode_outer(F.sequence(F.lit(-1), F.size("words") - 1))
    placed = read.select("rid", "words", F.size("words").alias("n_words"), places.alias("pos"))
    fits = [
        F.when((F.col("pos") >= 0) & (F.col("pos") + size <= F.col("n_words")), token(F.col("words"), F.col("pos"), size))
        for size in sizes
    ]
    if len(fits) == 1:
        return placed.withColumn("token", fits[0])
    # Items of fewer words than a shingle: their size is looked up as well, but place -1 stays one row.
    several = F.when(F.col("pos") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*fits))
    return placed.withColumn("token", F.explode_outer(several))


def table_bytes(df: DataFrame, *texts: str) -> int:
    """Bytes of the rows of a materialized table, from above: those of its texts, and ROW_BYTES a row."""
    sizes = sum((F.octet_length(c) for c in texts), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(sizes + ROW_BYTES), F.lit(0))).first()[0]


def rarest(df: DataFrame, windows: DataFrame, key: str, text: str, sizes: list[int], shingle: int, broadcast: int):
    """The prefix of each window: its shingle with the fewest occurrences in the documents.

    Windows with a shingle that does not occur at all are left out.
    """
    tokens = materialize(window_tokens(windows, sizes, shingle))
    known = materialize(tokens.select("token").distinct())
    wanted = F.broadcast(known) if table_bytes(known) <= broadcast else known
    counts = spots(df, key, text, sizes).select("token").join(wanted, "token").groupBy("token").count()
    order = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "offset")
    first = tokens.join(counts, "token", "left").groupBy("piece").agg(
        F.min(order).alias("prefix"), F.any_value("window").alias("window"), F.any_value("n").alias("n")
    )
    return first.filter("prefix.count > 0").select("prefix.token", "prefix.offset", "piece", "window", "n")


def occurrences(
    df: DataFrame, prefixes: DataFrame, key: str, text: str, sizes: list[int], window: int, broadcast: int
) -> DataFrame:
    """(rid, n_words, start, n, piece): where windows occur, and a row without a window for each document.

    Prefixes beyond the bound of a broadcast are joined by shuffle; a place then carries the words around
    it, so no text is copied.
    """
    found = spots(df, key, text, sizes)
    if table_bytes(prefixes, "piece", "piece") <= broadcast:
        prefixes = F.broadcast(prefixes)
        found = found.withColumn("base", F.lit(0)).withColumnRenamed("words", "around")
    else:
        base = F.greatest(F.col("pos") - window + 1, F.lit(0))
        around = F.slice("words", base + 1, 2 * window)
        found = found.select("rid", "n_words", "pos", "token", base.alias("base"), around.alias("around"))
        # Rows at place -1 have nothing to meet; a token of their own spreads them.
        own = F.when(F.col("pos") < 0, F.xxhash64("rid")).otherwise(F.col("token"))
        found = found.withColumn("token", own)
    met = prefixes.withColumnRenamed("token", "prefix")
    start = F.col("pos") - F.col("offset")
    bounds = (F.col("pos") >= 0) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    equal = F.slice("around", start - F.col("base") + 1, F.col("n")) == F.col("window")
    # The slice must not be looked at where the bounds do not hold.
    same = F.when(bounds, equal).otherwise(F.lit(False))
    joined = found.join(met, (F.col("token") == F.col("prefix")) & same, "left")
    return joined.filter("pos < 0 OR piece IS NOT NULL").select(
        "rid", "n_words", start.alias("start"), "n", "piece"
    )


def covered(hits: DataFrame) -> DataFrame:
    """(rid, spans, n_hit): the stretches of words that windows cover, and how many words they hold.

    Windows go by in order of their start; one that begins beyond all before it opens a stretch.
    """
    longest = hits.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    order = Window.partitionBy("rid").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("stretch", F.sum("opens").over(order))
    stretches = numbered.groupBy("rid", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return stretches.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
    )


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key, n_words, n_hit, items, spans) of every document row.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. `items` are the ids,
    as strings in their order, of the items a window of which the document holds word by word; `spans`
    the stretches of words (start, end; from 0, end exclusive) that such windows cover, `n_hit` their
    words. Whole texts are read, of any length. Null and empty texts have no words; items without words
    or without an id have no windows. Repeated documents each have their row, null keys included;
    repeated items count once. Other columns are not looked at. Without documents there are no rows,
    without items no hits.
    """
    listed = item_windows(items, item_key, item_text, window)
    listed = materialize(listed)
    windows = listed.select("piece", "window", "n").distinct()
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect()) or [shingle]
    prefixes = materialize(rarest(docs, windows, key, text, sizes, shingle, broadcast_bytes))
    found = materialize(occurrences(docs, prefixes, key, text, sizes, window, broadcast_bytes))
    hits = found.filter("piece IS NOT NULL").distinct()
    held = hits.select("rid", "piece").distinct().join(listed.select("piece", "item"), "piece")
    named = held.select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # Written before it is joined, so that the documents' side is a plain shuffle: rows that a third of
    # the table repeats make a large partition, which the adaptive skew join can split.
    judged = materialize(covered(hits).join(named, "rid"))
    rows = found.filter("piece IS NULL").select("rid", "n_words")
    return rows.join(judged, "rid", "left").select(
        F.col("rid.key").alias(key), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
