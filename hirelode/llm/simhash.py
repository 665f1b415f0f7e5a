"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint is a ring of eight bytes. If two differ in at most t bits, there is a byte from
which every chain of l consecutive bytes differs in at most l * t / 8 bits. For t = 3 the first two
bytes of that chain are equal and the next three hold one difference at most, so two of those three
are equal as well: 32 equal bits per start and left-out byte are the key under which two
fingerprints meet. Pairs that meet pass the budgets of all longer chains before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode.llm.common import prepare, with_columns
from hirelode.llm.components import components
from hirelode.session import materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS, WIDTH = 8, 8
#: Hashes that are turned into bits at a time.
SLICE = 65_536
#: Fingerprints that meet under one key are compared with each other; a key with more of them is
#: split by further bits until none has, see `refine`.
BUCKET = 2_048


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; its words, if they are fewer."""
    words = text.lower().split()  # of bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], dtype="<u8")
    shifted = zip(*[words[i:] for i in range(size)], strict=False)
    return np.fromiter((digest(b" ".join(s), SEED) for s in shifted), dtype="<u8")


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A bit is set if it is set in over half of the hashes; no words give zero."""
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    totals = np.zeros(len(texts), dtype=np.int64)
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle():
        nonlocal held
        if waiting:
            lengths = np.array([len(h) for _, h in waiting])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            counts[[i for i, _ in waiting]] = bit_counts(np.concatenate([h for _, h in waiting]), starts)
        waiting.clear()
        held = 0

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, size)
        totals[i] = len(hashes)
        if len(hashes) > SLICE:
            for at in range(0, len(hashes), SLICE):
                counts[i] += bit_counts(hashes[at : at + SLICE], np.zeros(1, dtype=np.int64))[0]
        elif len(hashes):
            waiting.append((i, hashes))
            held += len(hashes)
        if held > SLICE:
            settle()
    settle()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(
    df: DataFrame, text: str = "text", size: int = SHINGLE, out: str = "fp", keep: list[str] | None = None
) -> DataFrame:
    """Append the 64-bit fingerprint of every whole text as a signed long; null counts as empty."""

    def compute(column):
        values = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
        return [fingerprints_of(values, size).view("<i8")]

    return with_columns(df, [text], {out: "bigint"}, compute, keep)


def budgets(distance: int) -> list[int]:
    """Bits in which the first 1, 2, ... segments of a chain may differ."""
    return [length * distance // SEGMENTS for length in range(1, SEGMENTS + 1)]


def segment_mask(segment: int) -> int:
    return ((1 << WIDTH) - 1) << (WIDTH * (segment % SEGMENTS))


def root_keys(distance: int) -> list[tuple[int, int]]:
    """(start, mask of the bits that must be equal) for every start and left-out segment."""
    allowed = budgets(distance)
    equal, close = allowed.count(0), allowed.count(0) + allowed.count(1)
    keys = []
    for start in range(SEGMENTS):
        first = sum(segment_mask(start + i) for i in range(equal))
        for left_out in range(equal, close):
            rest = [i for i in range(equal, close) if i != left_out]
            keys.append((start, first + sum(segment_mask(start + i) for i in rest)))
        if equal == close:
            keys.append((start, first))
    return list(dict.fromkeys(keys)) if distance else [(0, (1 << 64) - 1)]


def refine(mask: int, distance: int) -> list[int]:
    """Masks with more bits: of distance + 1 parts of the other bits one must be equal."""
    others = [b for b in range(64) if not mask >> b & 1]
    if not others:
        return [mask]
    parts = np.array_split(np.array(others), min(distance + 1, len(others)))
    return [mask | sum(1 << int(b) for b in part) for part in parts]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def lookup(values: list[int], place: str) -> Column:
    listed = ", ".join(f"{v}L" for v in values)
    return F.expr(f"element_at(array({listed}), {place} + 1)")


def near(x: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """Whether the differing bits keep to the budgets of every chain from the start, and in all."""
    counts = np.bitwise_count(x.view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int64)
    total = np.zeros(len(x), dtype=np.int64)
    good = np.ones(len(x), dtype=bool)
    rows = np.arange(len(x))
    for step, allowed in enumerate(budgets(distance)):
        total += counts[rows, (starts + step) % SEGMENTS]
        good &= total <= allowed
    return good


def stars(fps: np.ndarray, run_ends: np.ndarray, starts: np.ndarray, distance: int) -> tuple:
    """Links of the rows of equal keys, each group of linked rows as a star around its smallest."""
    values, place = np.unique(fps, return_inverse=True)
    label = np.arange(len(values))
    at, step, found = np.arange(len(fps)), 1, []
    while len(at := at[at + step < run_ends[at]]):
        good = near(fps[at] ^ fps[at + step], starts[at], distance)
        found.append(np.stack([place[at[good]], place[at[good] + step]]))
        step += 1
    if not found:
        return values[:0], values[:0]
    a, b = np.concatenate(found, axis=1)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(before, label):
            break
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def bucket_links(distance: int):
    """Over rows (slot, value, start, fp) in order of (slot, value): links between fingerprints."""

    def batch(a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view("<i8"), type=pa.int64()), pa.array(b.view("<i8"), type=pa.int64())],
            names=["u", "v"],
        )

    def solve(rows: list[np.ndarray]):
        slot, value, start, fps = rows
        change = np.flatnonzero((slot[1:] != slot[:-1]) | (value[1:] != value[:-1])) + 1
        ends = np.concatenate([change, [len(slot)]])
        run_ends = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        return batch(*stars(fps, run_ends, start, distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            if not part.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            rows[3] = rows[3].view("<u8")
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            # The last key may go on in the next batch; a key has few rows.
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            last = int(np.argmax(same))
            if last:
                yield solve([r[:last] for r in rows])
            held = [r[last:] for r in rows]
        if held is not None:
            yield solve(held)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fingerprints in reach.

    `fps` holds distinct fingerprints (column fp). A key that more than `bucket` of them share is
    not compared but split by further bits, level by level: no pair is lost, and no task meets
    more than `bucket` rows of a key, or as many as the bits outside its last key can tell apart.
    """
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"distance must be in 0..{SEGMENTS - 1}")
    prepare(fps.sparkSession)
    keys = root_keys(distance)
    masks = [mask for _, mask in keys]
    slots = F.array(*[
        F.struct(
            F.lit(i).alias("slot"), F.lit(start).alias("start"),
            F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("bigint")).alias("value"),
        )
        for i, (start, mask) in enumerate(keys)
    ])
    keyed = fps.select("fp", F.explode(slots).alias("k")).select("k.slot", "k.value", "k.start", "fp")
    found = None
    while True:
        full = materialize(keyed.groupBy("slot", "value").count().filter(F.col("count") > bucket).drop("count"))
        last = full.isEmpty() or all(64 - mask.bit_count() <= bucket.bit_length() - 1 for mask in masks)
        fit = keyed if last else keyed.join(full, ["slot", "value"], "left_anti")
        placed = fit.repartition("slot", "value").sortWithinPartitions("slot", "value")
        made = placed.select("slot", "value", "start", "fp").mapInArrow(bucket_links(distance), "u bigint, v bigint")
        found = made if found is None else found.union(made)
        if last:
            return found
        split = [refine(mask, distance) for mask in masks]
        width = max(len(parts) for parts in split)
        masks = [parts[min(i, len(parts) - 1)] for parts in split for i in range(width)]
        part = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("part")
        keyed = materialize(
            keyed.join(full, ["slot", "value"], "left_semi")
            .select((F.col("slot") * width).alias("slot"), "start", "fp", part)
            .select((F.col("slot") + F.col("part")).alias("slot"), "start", "fp")
            .withColumn("value", F.col("fp").bitwiseAND(lookup([signed(m) for m in masks], "slot")))
            .select("slot", "value", "start", "fp")
        )


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(key, fp, component_id, text_hash, root) of every row: the smallest key that links of fingerprints reach.

    Two rows are linked if their fingerprints differ in at most `distance` bits; texts without words
    (null, empty, blank) have fingerprint zero and are linked like any others. Repeated rows, and
    rows that share a key, stay and are classed by their own text; text_hash tells them apart (zero
    for null). Components may have one smallest key if rows share it; their root, a fingerprint, tells them
    apart. Other columns are not looked at; an empty table gives no rows. A null key is not counted when
    the smallest is looked for.
    """
    named = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), text_hash(text).alias("text_hash")
    )
    marked = materialize(fingerprints(named, "text", size, keep=["key", "text_hash"]))
    fps = marked.groupBy("fp").agg(F.min("key").alias("first"))
    # What is joined is written before, so that both sides are plain shuffles: a fingerprint that a
    # third of the rows have, or the root of as many, makes a large partition, which the adaptive skew
    # join can split.
    member = components(links(fps.select("fp"), distance), "u", "v", "fp", "root")
    linked = materialize(member.join(fps, "fp"))
    smallest = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    classed = linked.join(smallest, "root").select("fp", "component_id", "root")
    classes = materialize(fps.join(classed, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")
    ))
    return marked.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id", "text_hash", "root")


def text_hash(text: str) -> Column:
    return F.when(F.col(f"`{text}`").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(f"`{text}`"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of near-duplicates one row: that of the smallest key; columns stay.

    If rows of a component share that key, the text with the smallest hash stays, once. Rows of one key
    in several components are apart, and each component keeps its own. A component of rows without any
    key has nothing to tell which is first: its rows all stay.
    """
    classes = near_duplicates(df.select(f"`{key}`", f"`{text}`"), key, text)
    named = F.struct(F.col(f"`{key}`").alias("key"), F.col("text_hash").alias("hash"))
    kept = classes.filter(F.col(f"`{key}`") == F.col("component_id")).groupBy("root").agg(F.min(named).alias("least"))
    kept = kept.select(F.col("least.key").alias("__llm_key"), F.col("least.hash").alias("__llm_hash"))
    hashed = df.withColumn("__llm_text", text_hash(text))
    same = (F.col(f"`{key}`") == F.col("__llm_key")) & (F.col("__llm_text") == F.col("__llm_hash"))
    rows = hashed.join(kept, same, "left_semi").dropDuplicates([key, "__llm_text"])
    unkeyed = classes.filter("component_id IS NULL").select(F.col("text_hash").alias("__llm_hash")).distinct()
    loose = hashed.filter(F.col(f"`{key}`").isNull()).join(unkeyed, F.col("__llm_text") == F.col("__llm_hash"), "left_semi")
    return rows.union(loose).select(*[f"`{c}`" for c in df.columns])


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
