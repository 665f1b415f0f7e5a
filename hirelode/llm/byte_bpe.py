"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from hirelode.llm.common import texts_of, with_columns

#: Texts are handed to the library in pieces of about this many characters.
PIECE_CHARS = 65_536
#: Longer runs of white space overflow the stack of the library's pattern matcher.
LONG_RUN = 4_096

LONG_SPACE = regex.compile(r"\s{%d,}" % LONG_RUN)
#: No match of the pattern goes from a character that is no white space to white space, and the
#: pattern looks only ahead, to the next character: both sides of such a place are independent.
BOUNDARY = regex.compile(r"\S(?=\s)|\p{L}(?=\p{N})|\p{N}(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def whole_match(rank_path: str) -> tiktoken.Encoding:
    """The same ranks, with the text as one match."""
    return encoding(rank_path, r"(?s).+")


def at_boundaries(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries, into pieces of `size` characters or a little more.

    A run without any boundary stays whole, since the merges of one match depend on all of it.
    """
    start = 0
    while len(text) - start > size:
        found = BOUNDARY.search(text, start + size - 1)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def encode(text: str, rank_path: str, pattern: str) -> list[int]:
    """Ids of a text, as `encode_ordinary` gives them, for texts of any length."""
    plain, whole = encoding(rank_path, pattern), whole_match(rank_path)
    if len(text) < LONG_RUN:
        return plain.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in LONG_SPACE.finditer(text):
        # `\s+(?!\S)` takes a run up to its last character, or all of it at the end of the text.
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in at_boundaries(text[start : run.start()]):
            ids += plain.encode_ordinary(piece)
        ids += whole.encode_ordinary(text[run.start() : end])
        start = end
    for piece in at_boundaries(text[start:]):
        ids += plain.encode_ordinary(piece)
    return ids


def encode_texts(
    df: DataFrame, rank_path: str, pattern: str, text: str = "text",
    ids: str = "ids", count: str = "n_tokens", keep: list[str] | None = None,
) -> DataFrame:
    """Append the ids of every whole text, as little-endian unsigned 32-bit integers, and their number.

    Each match of the pattern is encoded separately, without special tokens: their strings are
    ordinary text. A null or empty text has no ids. Repeated rows stay, each with its ids. Columns
    named as the outputs are replaced. `rank_path` is read on the executors.
    """

    def compute(column):
        rows = [np.array(encode(t, rank_path, pattern), dtype="<u4") for t in texts_of(column)]
        return [r.tobytes() for r in rows], [len(r) for r in rows]

    return with_columns(df, [text], {ids: "binary", count: "bigint"}, compute, keep)


def decode_texts(
    df: DataFrame, rank_path: str, pattern: str, ids: str = "ids",
    decoded: str = "decoded", keep: list[str] | None = None,
) -> DataFrame:
    """Append the raw bytes that the ids stand for. Null ids give no bytes (an empty value).

    Bytes, not text: ids may end amid a character. An id that has no rank raises an error.
    """

    def compute(column):
        decoder = encoding(rank_path, pattern)
        return [
            [decoder.decode_bytes(np.frombuffer(v or b"", dtype="<u4").tolist()) for v in column.to_pylist()]
        ]

    return with_columns(df, [ids], {decoded: "binary"}, compute, keep)
