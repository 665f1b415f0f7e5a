"""Greedy word-piece lengths in linear time, by a longest-match automaton.

The vocabulary is a trie. A node v that cannot go on with the next byte pops the pieces that
greedy longest-match surely takes from the text of v, and goes on at the node of what is left:
its failure link. Only the number of popped pieces is stored, so counting builds no pieces. Each
byte is read once and each failure link consumes a piece, so a word of any length takes linear time.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from hirelode.llm.common import texts_of, with_columns

#: Words remembered by each worker; beyond this the memory starts anew, results do not change.
MEMORY = 200_000


class Automaton:
    """Trie with failure links. A word is matched behind a leading space, as the vocabulary has it."""

    def __init__(self, pieces: list[bytes]):
        if missing := {bytes([b]) for b in range(256)} - set(pieces):
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                node = self.children[node][byte]
            whole[node] = True
        self.link = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        self._link(whole)

    def _link(self, whole: list[bool]) -> None:
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.children[parent].items():
                queue.append(node)
                if whole[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                # The text of node is that of its parent and one byte more: pop from the parent
                # until what is left of it can take the byte.
                state, popped = self.link[parent], self.popped[parent]
                while byte not in self.children[state]:
                    popped += self.popped[state]
                    state = self.link[state]
                self.link[node], self.popped[node] = self.children[state][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match over the word."""
        children, link, popped = self.children, self.link, self.popped
        state = total = 0
        for byte in word:
            while (following := children[state].get(byte)) is None:
                total += popped[state]
                state = link[state]
            state = following
        while state:
            total += popped[state]
            state = link[state]
        return total


@lru_cache(maxsize=2)
def automaton(rank_path: str) -> Automaton:
    with open(rank_path, "rb") as lines:
        return Automaton([base64.b64decode(line.split()[0]) for line in lines if line.strip()])


@lru_cache(maxsize=2)
def memory(rank_path: str) -> dict[str, int]:
    return {}


def count_pieces(texts: list[str], rank_path: str) -> tuple[list[int], list[int]]:
    """Words and pieces of each text."""
    machine, known = automaton(rank_path), memory(rank_path)
    words, pieces = [], []
    for text in texts:
        parts = text.split()
        fresh = set(parts).difference(known)
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            fresh = set(parts)
        for word in fresh:
            known[word] = machine.count(b" " + word.encode("utf-8", "surrogatepass"))
        words.append(len(parts))
        pieces.append(sum(map(known.__getitem__, parts)))
    return words, pieces


def token_counts(
    df: DataFrame, rank_path: str, text: str = "text", keep: list[str] | None = None,
    words: str = "n_words", pieces: str = "n_pieces",
) -> DataFrame:
    """Append the number of words and of word pieces of every whole text.

    Words are what white space separates. The vocabulary is a file of ranks over bytes, whose pieces
    with a leading space begin a word; every single byte is a piece, so nothing is unknown. A null,
    empty or blank text has no words and no pieces. Repeated rows stay, each with its counts; columns
    named as the outputs are replaced.
    """
    return with_columns(
        df, [text], {words: "bigint", pieces: "bigint"},
        lambda column: count_pieces(texts_of(column), rank_path), keep,
    )
