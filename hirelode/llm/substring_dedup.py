"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk may end where it is the least of some 32 places
in a row. Such places depend on the bytes around them only, so text that was inserted before a passage
does not move the cuts within it, and no 32 places are without one, repetitive text included. Chunks
that several documents hold are found by digest; neighbouring ones join to spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelode.llm.common import prepare, with_columns
from hirelode.operators.joins import flagged, may_be_in
from hirelode.session import materialize

#: The hash has 16 bits and shifts by one for each byte, so its window is 16 bytes.
WINDOW = 16
#: The least hash of so many places in a row is a cut.
PLACES = 32
LEAST, MOST = 16, 256
#: A span is reported from this many characters on: more than a line of a few words, which many
#: documents may share. A repeated passage loses 16 bytes and about a chunk at its ends, 44 bytes as a rule
#: and seldom more than 100; one of 50 words has more left.
LEAST_SPAN = 96
#: A cut moves to the edge of a word by so many characters at most.
WORD_REACH = 40

GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) & 0xFFFF for b in range(256)], dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte: the sum of GEAR[byte k places back] << k, modulo 2**16.

    The sum over 2n bytes is that over the last n and, shifted by n, that over the n before.
    """
    rolled = GEAR[data]
    step = 1
    while step < WINDOW:
        shifted = np.zeros_like(rolled)
        shifted[step:] = rolled[:-step] << np.uint16(step)
        rolled = rolled + shifted
        step *= 2
    return rolled


def slide(values: np.ndarray, size: int, better: np.ufunc) -> np.ndarray:
    """The least or greatest of every `size` values in a row."""
    step = 1
    while step < size:
        more = min(step, size - step)
        values = better(values[:-more], values[more:])
        step += more
    return values


def least_places(rolled: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some PLACES in a row, all of them where several are equal."""
    if len(rolled) < PLACES:
        return np.zeros(0, dtype=np.int64)
    least = np.pad(slide(rolled, PLACES, np.minimum), PLACES - 1)
    return np.flatnonzero(slide(least, PLACES, np.maximum) == rolled)


def cuts_of(candidates: list[int], starts: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from begin to end; `starts` marks bytes that begin a character."""
    ends, at = [], begin
    for place in (*candidates, end):
        while place - at > MOST:
            at += MOST
            while not starts[at]:
                at -= 1
            ends.append(at)
        if place - at >= LEAST or place == end:
            ends.append(place)
            at = place
    return ends


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first character, characters, digest high, digest low) of all chunks.

    Cuts lie between characters. The window starts anew with each text.
    """
    data = b"".join(texts)
    flat = np.frombuffer(data, dtype=np.uint8)
    starts = np.append((flat & 0xC0) != 0x80, True)
    characters = np.concatenate([[0], np.cumsum(starts[:-1])])
    rolled = gear_hashes(flat)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    numbers, begins, ends = [], [], []
    for i in range(len(texts)):
        begin, end = int(bounds[i]), int(bounds[i + 1])
        if begin == end:
            continue
        # A cut comes behind a byte; the window must lie in the text, so early places do not count.
        early = begin + WINDOW - 1
        places = least_places(rolled[early : end - 1]) + early + 1
        made = cuts_of(places[starts[places]].tolist(), starts, begin, end)
        numbers += [i] * len(made)
        begins.append(begin)
        begins += made[:-1]
        ends += made
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(data[b:e]) for b, e in zip(begins, ends, strict=True)])
    halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    number, begin, end = (np.array(x, dtype=np.int64) for x in (numbers, begins, ends))
    first = characters[begin] - characters[bounds[number]]
    return number, first, characters[end] - characters[begin], halves[:, 0], halves[:, 1]


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(key, the columns to keep, start, length, high, low) of every chunk of every whole text."""
    prepare(df.sparkSession)
    made = T.StructType.fromDDL("start int, length int, high bigint, low bigint")
    kept = [key, *keep]
    schema = T.StructType([*[df.schema[c] for c in kept], *made.fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            texts = [v or b"" for v in batch.column(len(kept)).cast(pa.binary()).to_pylist()]
            number, first, size, high, low = chunks_of(texts)
            if len(number):
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).take(pa.array(number)) for i in range(len(kept))],
                    pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array(high.astype(np.int64)), pa.array(low.astype(np.int64)),
                ], names=names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def told_apart(df: DataFrame, key: str, text: str) -> DataFrame:
    """Append __llm_row, which tells rows of one key and unlike texts apart: the hash of the text.

    It is 0 for a row that has its key for itself, as nearly all have. Which may not is looked up in a
    filter of bounded size; texts are not shuffled.
    """
    hashed = F.xxhash64(F.col(f"`{text}`"))
    several = df.select(F.col(f"`{key}`").alias("__llm_id"), hashed.alias("h")).groupBy("__llm_id").agg(
        F.min("h").alias("least"), F.max("h").alias("most")
    ).filter("least < most").select("__llm_id")
    marked = flagged(df.withColumn("__llm_id", F.col(f"`{key}`")), several, "__llm_id", "__llm_shared")
    row = F.when(F.col("__llm_shared"), hashed).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("__llm_row", row).drop("__llm_id", "__llm_shared")


def spans_of(told: DataFrame, key: str, text: str, least_span: int) -> DataFrame:
    """(key, row, start, end, first) of the spans of rows `told_apart`."""
    keyed = told.filter(F.col(f"`{key}`").isNotNull())
    found = chunks(keyed, key, text, "__llm_row").withColumnRenamed(key, "key").withColumnRenamed("__llm_row", "row")
    held = found.groupBy("high", "low").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # Written, as it is used twice, and so that both sides of the join are plain shuffles, which the adaptive
    # skew join can split.
    shared = materialize(held.filter("first < last").drop("last"))
    # Chunks that surely one key alone holds go before they are shuffled again.
    digest = F.struct("high", "low").alias("digest")
    likely = may_be_in(found.select("*", digest), shared.select(digest), "digest").drop("digest")
    copies = likely.join(shared, ["high", "low"]).filter("key > first")
    # Repeated rows meet here, ahead of the window, whose group is then one text.
    pieces = copies.groupBy("key", "row", "start").agg(
        F.max(F.col("start") + F.col("length")).alias("end"), F.min("first").alias("first")
    )
    order = Window.partitionBy("key", "row").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("opens").over(order))
    spans = numbered.groupBy("key", "row", "span").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
        F.min_by("first", "start").alias("first"),
    )
    return spans.filter(F.col("end") - F.col("start") >= least_span).drop("span")


def repeated_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_span: int = LEAST_SPAN
) -> DataFrame:
    """Spans that a document shares with documents of smaller keys: (key, start, end, first_key, row).

    Start and end count characters, the end is exclusive; `first_key` is the smallest key that holds
    the span's first chunk, and the span stays there. Whole texts are read, of any length; a null or
    empty text has no spans. Text that repeats within one document alone is not reported, nor is what
    rows of one key share with each other alone; if their texts are unlike, `row`, else 0, is the hash of
    the text that the span is in. Repeated rows give their spans once. Rows with a null key take no part.
    Other columns are not looked at; an empty table gives no rows.

    One combining aggregate finds the chunks that two or more documents hold, so a chunk of a third
    of all documents shuffles one row per task. The join that follows sees the chunks that a membership
    filter of them lets through and is left to skew handling. Neighbouring chunks of a text join to spans
    in one pass in order of their start.
    """
    told = told_apart(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text)
    return spans_of(told, key, text, least_span).select(
        F.col("key").alias(key), "start", "end", F.col("first").alias(f"first_{key}"), "row"
    )


def shrink(text: str, start: int, end: int) -> tuple[int, int]:
    """The whole words of a span, without the white space around them.

    A word that goes on for more than WORD_REACH characters is cut where the span ends, so text
    without blanks loses nothing; a span of a part of one shorter word is empty.
    """
    if 0 < start:
        near = range(start, min(start + WORD_REACH, end) + 1)
        start = next((i for i in near if i == end or text[i - 1].isspace()), start)
    if end < len(text):
        near = range(end, max(end - WORD_REACH, start) - 1, -1)
        end = next((i for i in near if i == start or text[i].isspace()), end)
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    return start, end


def without(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in sorted(spans):
        start, end = shrink(text, max(start, at), end)
        if start < end:
            parts.append(text[at:start])
            at = end
    return "".join([*parts, text[at:]])


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_span: int = LEAST_SPAN
) -> DataFrame:
    """The rows with the spans of `repeated_spans` taken out of their texts, at whole words.

    The first document that holds a span keeps it. Rows whose text is taken out altogether, up to
    white space, go; all other rows stay, those with a null key or text as they are, and each row loses
    the spans of its own text only, whichever rows share its key. Columns stay.
    """
    told = told_apart(df, key, text)
    spans = spans_of(told.select(F.col(f"`{key}`"), F.col(f"`{text}`"), "__llm_row"), key, text, least_span)
    listed = F.transform(F.collect_list(F.struct("start", "end")), lambda s: F.concat_ws(":", s["start"], s["end"]))
    spans = spans.groupBy("key", "row").agg(F.array_join(listed, ",").alias("__llm_spans")).select(
        F.col("key").alias("__llm_key"), F.col("row").alias("__llm_in"), "__llm_spans"
    )
    own = (F.col(f"`{key}`") == F.col("__llm_key")) & (F.col("__llm_row") == F.col("__llm_in"))
    joined = told.join(spans, own, "left").drop("__llm_key", "__llm_in", "__llm_row")

    def compute(texts, found):
        cleaned, left = [], []
        for value, listed in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            if listed:
                value = without(value or "", [tuple(map(int, s.split(":"))) for s in listed.split(",")])
            cleaned.append(value)
            left.append(not listed or bool(value.strip()))
        return cleaned, left

    made = with_columns(joined, [text, "__llm_spans"], {text: "string", "__llm_left": "boolean"}, compute)
    return made.filter("__llm_left").select(*[f"`{c}`" for c in df.columns])
