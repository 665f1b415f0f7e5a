"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hirelode.llm.common import prepare

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 1
TOKENS = 2048
#: Segments of one sequence; a limit on the attention mask, far above what documents need.
SEGMENTS = 256
#: Pieces that wait for a place; a larger pool finds better fits, at the cost of memory.
POOL = 1_024
#: A gap below this many tokens is padded, unless a whole piece fits: no piece is cut that short.
LEAST_CUT = 8
#: Sequences of one partition; the number of the partition stands above it.
SEQUENCE_BITS = 40
#: Words that each worker remembers, the first ones it meets; others are merged each time.
MEMORY = 300_000
#: Longer ones are not remembered, so that the memory is bounded in bytes.
LONGEST = 64
#: Ahead of a part of a text with unusual characters, in the memory; no part holds it.
BETWEEN_MARK = " "

#: Up to here, case, normal form and class of a character agree in all Unicode versions, and its
#: lower case lies here too; texts with others go to the library.
LAST_PLAIN = 0x17F
PLAIN_BLANKS = re.compile("[\\t-\\r\\x20]+")
UNUSUAL = re.compile(f"[^\\t-\\r\\x20-\\x7e\\xa1-\\u{LAST_PLAIN:04x}]|<\\|")
LETTERS = "".join(
    f"\\u{n:04x}" for n in range(LAST_PLAIN + 1) if unicodedata.category(chr(n))[0] == "L"
)
DIGITS = "".join(
    f"\\u{n:04x}" for n in range(LAST_PLAIN + 1) if unicodedata.category(chr(n))[0] == "N"
)
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of a text as the tokenizer gives them; the ids of a word are kept, since words repeat.

    The tokenizer normalizes a text (NFC, white space, lower case), cuts it into words and merges
    within each. For texts of plain characters the same is done here once per word, with the
    tokenizer's own merges; parts with other characters go to the tokenizer, each as it stands between
    plain white space.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.words = re.compile(WORDS)
        self.letters = byte_letters()
        self.known_words: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = self.merge(word)
        return pack_ids(f"<{len(ids)}I", *[t.id for t in ids])

    def part(self, part: str) -> bytes:
        """Ids of what stands between white space."""
        known, words = self.known_words, self.words.findall(part)
        if len(words) == 1 and words[0] == part:
            return known.get(part) or self.word(part)
        ids = []
        for word in words:
            if (merged := known.get(word)) is None:
                merged = self.word(word)
                if len(known) < MEMORY and len(word) <= LONGEST:
                    known[word] = merged
            ids.append(merged)
        return b"".join(ids)

    def unusual(self, part: str) -> bytes:
        """Ids of a part that holds an unusual character: from the library, which cuts at white space first."""
        return self.library(part) if UNUSUAL.search(part) else self.part(plain(part))

    def __call__(self, text: str) -> bytes:
        known, make = self.known_parts, self.part
        if UNUSUAL.search(text):
            # Parts between plain white space are cut, normalized and merged each by itself, so a text goes
            # to the library in its unusual parts alone. They are marked, as plain ones are lower-cased.
            parts, make = [BETWEEN_MARK + p for p in PLAIN_BLANKS.split(text) if p], lambda p: self.unusual(p[1:])
        else:
            parts = plain(text).split()
        fresh = set(parts).difference(known)
        made = {part: make(part) for part in fresh}
        if len(known) + len(fresh) <= MEMORY:
            known.update((part, ids) for part, ids in made.items() if len(part) <= LONGEST)
        return b"".join([ids if (ids := known.get(p)) is not None else made[p] for p in parts])


def plain(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Fills one sequence after the other from a pool of waiting pieces.

    The next piece of a sequence is the one that fits whose size vector (tokens, segments,
    loss-bearing tokens, as shares of the limits) has the largest dot product with what is left of
    the sequence. When no whole piece fits, the one that would have been taken is cut at the gap.
    """

    def __init__(self, limits: Sequence[int], least_cut: int, number: Iterator[int]):
        self.limits = np.array(limits, dtype=np.int64)
        self.least_cut, self.number = least_cut, number
        self.pieces: list[tuple] = []  # (key, start, ids, loss flags)
        self.sizes = np.zeros((64, 3), dtype=np.int64)
        self.count = 0

    def add(self, piece: tuple) -> None:
        if self.count == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[self.count] = size_of(piece)
        self.pieces.append(piece)
        self.count += 1

    def take(self, place: int) -> tuple:
        piece, last = self.pieces[place], self.pieces.pop()
        self.count -= 1
        if place < self.count:
            self.pieces[place] = last
            self.sizes[place] = self.sizes[self.count]
        return piece

    def fill(self) -> list[tuple]:
        """One sequence: rows (key, start, ids, sequence, offset)."""
        sequence, offset, rows = next(self.number), 0, []
        left = self.limits.copy()
        while self.count and left[0] > 0 and left[1] > 0:
            sizes = self.sizes[: self.count]
            fits = (sizes <= left).all(axis=1)
            if rows and not fits.any() and left[0] < self.least_cut:
                break
            score = (sizes / self.limits) @ (left / self.limits)
            if fits.any():
                piece = self.take(int(np.where(fits, score, -1.0).argmax()))
            else:
                piece, rest = cut(self.take(int(score.argmax())), left)
                if rest is not None:
                    self.add(rest)
                if piece is None:  # no loss-bearing token may come any more
                    break
            left -= size_of(piece)
            rows.append((piece[0], piece[1], piece[2], sequence, offset))
            offset += len(piece[2]) // 4
        return rows


def size_of(piece: tuple) -> tuple[int, int, int]:
    tokens = len(piece[2]) // 4
    return tokens, 1, tokens if piece[3] is None else int(np.count_nonzero(piece[3]))


def cut(piece: tuple, left: np.ndarray) -> tuple[tuple | None, tuple | None]:
    """The longest beginning that fits, and the rest."""
    key, start, ids, loss = piece
    n = min(len(ids) // 4, int(left[0]))
    if loss is None:
        n = min(n, int(left[2]))
    else:
        n = min(n, int(np.searchsorted(np.cumsum(loss), left[2], side="right")))
    if n == 0:
        return None, piece
    head = (key, start, ids[: 4 * n], None if loss is None else loss[:n])
    if 4 * n == len(ids):
        return head, None
    return head, (key, start + n, ids[4 * n :], None if loss is None else loss[n:])


def pack(
    documents: Iterator[tuple], limits: Sequence[int] = (TOKENS, SEGMENTS, TOKENS),
    least_cut: int = LEAST_CUT, pool: int = POOL, first: int = 0,
) -> Iterator[list[tuple]]:
    """Pack (key, ids, loss flags) into sequences; memory holds the pool and one document.

    Loss flags are one byte per id, or None when every id bears loss.
    """
    if min(limits) < 1:
        raise ValueError("every limit must be at least 1")

    def numbers():
        n = first
        while True:
            yield n
            n += 1

    packer = Packer(limits, least_cut, numbers())
    full = min(limits[0], limits[2])
    for key, ids, loss in documents:
        start, step = 0, 4 * full
        while loss is None and len(ids) - 4 * start >= step:
            # A full stretch is a sequence of its own if the tokens are what fills it up.
            if full < limits[0]:
                break
            yield [(key, start, ids[4 * start : 4 * start + step], next(packer.number), 0)]
            start += full
        while 4 * start < len(ids):
            n = min(limits[0], len(ids) // 4 - start)
            part = ids[4 * start : 4 * (start + n)]
            packer.add((key, start, part, None if loss is None else loss[start : start + n]))
            start += n
        while packer.count >= pool:
            yield packer.fill()
    while packer.count:
        yield packer.fill()


def pack_texts(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
    loss: str | None = None, limits: Sequence[int] = (TOKENS, SEGMENTS, TOKENS),
    least_cut: int = LEAST_CUT, end_id: int = END_ID,
) -> DataFrame:
    """Encode every whole text, append the end id, and pack all ids into sequences.

    Returns a row per piece: the key, start (ids of its text before it), length, ids (little-endian
    unsigned 32-bit integers), doc_tokens (ids of the text with the end id), sequence_id, offset in
    the sequence (without gaps, from 0). `loss` names a boolean column that says whether the ids of
    a row bear loss (null: they do not); without it all do. Every id lies in exactly one piece.

    Each partition fills sequences of its own, so padding is left over once per partition and
    nothing is shuffled; a sequence id is the partition's number and a count. A null or empty text
    is its end id alone. Repeated rows are packed each. Other columns are not looked at. An empty
    table gives no rows.
    """
    prepare(df.sparkSession)
    made = T.StructType.fromDDL(
        "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    schema = T.StructType([df.schema[key], *made.fields])
    names = [f.name for f in schema.fields]
    closing = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        kinds: list[pa.DataType] = []

        def documents():
            for batch in batches:
                if not kinds:
                    kinds.append(batch.schema.types[0])
                flags = batch.column(2).to_pylist() if loss else [True] * batch.num_rows
                for k, t, bears in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), flags, strict=True):
                    ids = encode(t or "") + closing
                    yield (k, len(ids) // 4), ids, None if bears else bytes(len(ids) // 4)

        def block(rows):
            keys, starts, ids, sequences, offsets = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in keys], type=kinds[0]), pa.array(starts, type=pa.int64()),
                pa.array([len(i) // 4 for i in ids], type=pa.int64()), pa.array(ids, type=pa.binary()),
                pa.array([n for _, n in keys], type=pa.int64()),
                pa.array(sequences, type=pa.int64()), pa.array(offsets, type=pa.int64()),
            ], names=names)

        rows: list[tuple] = []
        first = TaskContext.get().partitionId() << SEQUENCE_BITS
        for sequence in pack(as_flags(documents()), limits, least_cut, first=first):
            rows += sequence
            if len(rows) >= 2_048:
                yield block(rows)
                rows = []
        if rows:
            yield block(rows)

    picked = [F.col(f"`{key}`"), F.col(f"`{text}`")]
    if loss:
        picked.append(F.coalesce(F.col(f"`{loss}`").cast("boolean"), F.lit(False)))
    return df.select(*picked).mapInArrow(run, schema)


def as_flags(documents: Iterator[tuple]) -> Iterator[tuple]:
    for key, ids, loss in documents:
        yield key, ids, None if loss is None else np.frombuffer(loss, dtype=np.uint8)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, n_segments, n_tokens and ids without padding.

    A sequence has a bounded number of pieces, so its group is small.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = pieces.groupBy("sequence_id").agg(ordered.alias("parts"))
    return joined.select(
        "sequence_id",
        F.size("parts").cast("long").alias("n_segments"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("n_tokens"),
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )
