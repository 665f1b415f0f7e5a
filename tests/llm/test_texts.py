"""Token counts, byte-level BPE and packing against plain versions."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hirelode.llm import byte_bpe, packing, quality, token_counts
from hirelode.llm.queries import BYTE_RANKS, WORD_TOKENIZER
from tests.llm.conftest import EDGE

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return byte_bpe.encoding(BYTE_RANKS, PATTERN)


def greedy(word, vocabulary, longest):
    count = at = 0
    while at < len(word):
        end = min(len(word), at + longest)
        while word[at:end] not in vocabulary:
            end -= 1
        at, count = end, count + 1
    return count


def test_automaton_counts_greedy_pieces(plain):
    machine = token_counts.automaton(BYTE_RANKS)
    vocabulary = set(plain.token_byte_values())
    longest = max(map(len, vocabulary))
    draw = random.Random(1)
    for _ in range(3_000):
        word = bytes(draw.choice(b" abetionhsr,.\xc3\xa9\n01") for _ in range(draw.randint(0, 30)))
        assert machine.count(word) == greedy(word, vocabulary, longest)


def test_token_counts_of_edge_rows(edge, empty, plain, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    vocabulary = set(plain.token_byte_values())
    longest = max(map(len, vocabulary))
    got = token_counts.token_counts(edge, BYTE_RANKS).collect()
    assert len(got) == len(EDGE)
    for row in got:
        words = (row.text or "").split()
        assert (row.n_words, row.n_pieces) == (
            len(words), sum(greedy(b" " + w.encode(), vocabulary, longest) for w in words)
        )
    assert token_counts.token_counts(empty, BYTE_RANKS).collect() == []


def test_vocabulary_must_hold_every_byte():
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


def test_long_texts_are_cut_where_ids_do_not_change(plain, monkeypatch):
    draw = random.Random(2)
    signs = ["a", "é", " ", "  ", "\n", "1", "²", "'s", "'", "...", "\x1c", "\xa0", "日", "    "]
    monkeypatch.setattr(byte_bpe, "LONG_RUN", 3)
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 20)
    monkeypatch.setattr(byte_bpe, "LONG_SPACE", byte_bpe.regex.compile(r"\s{3,}"))
    for _ in range(500):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 200)))
        assert b"".join(p.encode() for p in byte_bpe.at_boundaries(text, 20)) == text.encode()
        assert byte_bpe.encode(text, BYTE_RANKS, PATTERN) == plain.encode_ordinary(text), text


def test_long_runs_of_white_space_are_encoded(plain):
    text = "a" + " " * 300_000 + "b"
    ids = byte_bpe.encode(text, BYTE_RANKS, PATTERN)
    assert plain.decode_bytes(ids) == text.encode()


def test_byte_bpe_round_trip(edge, empty, plain):
    encoded = byte_bpe.encode_texts(edge, BYTE_RANKS, PATTERN)
    rows = byte_bpe.decode_texts(encoded, BYTE_RANKS, PATTERN).collect()
    assert len(rows) == len(EDGE)
    for row in rows:
        ids = np.frombuffer(row.ids, dtype="<u4").tolist()
        assert ids == plain.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids)
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_bpe.encode_texts(empty, BYTE_RANKS, PATTERN).collect() == []


def test_word_encoder_agrees_with_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    encoder = packing.WordEncoder(WORD_TOKENIZER)
    library = Tokenizer.from_file(WORD_TOKENIZER)
    library.encode_special_tokens = True
    draw = random.Random(3)
    signs = [chr(c) for c in range(0x260)] + ["'s", "'RE", "İ", " ΑΣ ", "é", "日本", "<|endoftext|>", "½"]
    for _ in range(3_000):
        text = "".join(
            draw.choice(signs) if draw.random() < 0.5 else draw.choice("abc 'st.\n12") for _ in range(draw.randint(0, 30))
        )
        ids = np.frombuffer(encoder(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, expected, limits=(packing.TOKENS, packing.SEGMENTS, packing.TOKENS)):
    """Every id in one piece, sequences without gaps and within the limits."""
    texts, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        texts[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    got = defaultdict(list)
    for key, pieces in texts.items():
        joined = b""
        for start, ids, total in sorted(pieces):
            if start == 0 and joined:
                got[key].append(joined)
                joined = b""
            assert start in (0, len(joined) // 4)
            joined += ids
        got[key].append(joined)
    assert {k: sorted(v) for k, v in got.items()} == expected
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits[0] and len(pieces) <= limits[1]
    return by_sequence


def test_packing_covers_every_id_once(spark, edge, empty):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    rows = packing.pack_texts(edge.filter("doc_id NOT IN (4, 9)"), WORD_TOKENIZER).collect()
    expected = defaultdict(list)
    for key, text, _ in EDGE:
        if key not in (4, 9, None):
            ids = library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
            expected[key].append(np.array(ids, dtype="<u4").tobytes())
    check_packing(rows, {k: sorted(v) for k, v in expected.items()})
    # The rows that repeat and the one without a key are packed as well.
    assert packing.pack_texts(edge, WORD_TOKENIZER).filter("start = 0").count() == len(EDGE)
    assert packing.pack_texts(empty, WORD_TOKENIZER).collect() == []


def test_little_padding_and_whole_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack_texts(docs, WORD_TOKENIZER).cache()
    whole = packing.sequences(pieces).collect()
    tokens = sum(r.n_tokens for r in whole)
    assert tokens / (len(whole) * packing.TOKENS) > 0.98
    by_sequence = defaultdict(list)
    for r in pieces.collect():
        by_sequence[r.sequence_id].append((r.offset, bytes(r.ids)))
    for r in whole:
        parts = sorted(by_sequence[r.sequence_id])
        assert bytes(r.ids) == b"".join(ids for _, ids in parts)
        assert r.n_segments == len(parts) and r.n_tokens == len(r.ids) // 4


def test_three_limits_hold_at_once():
    draw = random.Random(4)
    documents = []
    for key in range(200):
        n = draw.randint(1, 300)
        loss = np.array([draw.random() < 0.5 for _ in range(n)], dtype=np.uint8)
        documents.append((key, np.arange(n, dtype="<u4").tobytes(), loss if key % 3 else None))
    limits = (128, 4, 40)
    flags = {key: (np.ones(len(ids) // 4, dtype=np.uint8) if loss is None else loss) for key, ids, loss in documents}
    covered = defaultdict(int)
    for rows in packing.pack(iter(documents), limits, least_cut=4, pool=20):
        used = [0, 0, 0]
        for key, start, ids, _, offset in rows:
            n = len(ids) // 4
            assert offset == used[0]
            used = [used[0] + n, used[1] + 1, used[2] + int(flags[key][start : start + n].sum())]
            covered[key] += n
        assert all(u <= limit for u, limit in zip(used, limits, strict=True)) and used[1]
    assert covered == {key: len(ids) // 4 for key, ids, _ in documents}


def test_loss_column_counts(spark):
    rows = [(1, "a b c d", True), (2, "e f g", False), (3, "h", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bears boolean")
    pieces = packing.pack_texts(docs.coalesce(1), WORD_TOKENIZER, loss="bears", limits=(64, 8, 5)).collect()
    assert len({r.sequence_id for r in pieces}) == 1


def test_unusual_parts_of_a_text_go_to_the_library_alone(monkeypatch):
    random.seed(6)
    encode, library = packing.WordEncoder(WORD_TOKENIZER), Tokenizer.from_file(WORD_TOKENIZER)
    library.encode_special_tokens = True
    pieces = ["Word", "straße", "İstanbul", "日本語", "étude", "́", "a b", "x　y", "Σίσυφος ΣΑΣ", "<|endoftext|>", "😀ok", "​", "don't", "1234",
              "ǅ", "ﬁn", "\x1c", "\x85", "K", "Å", "﻿", "٣٤"]
    for _ in range(400):
        text = "".join(random.choice(pieces) + random.choice([" ", "\n", "  ", "\t\r\n", ""]) for _ in range(random.randint(1, 12)))
        ids = np.frombuffer(encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
    seen = []
    monkeypatch.setattr(encode, "library", lambda part: seen.append(part) or b"")
    encode("plain words " * 10_000 + "日本 " + "more " * 10_000 + "x" * 500)
    assert seen == ["日本"] or seen == []
    assert max(map(len, encode.known_parts)) <= packing.LONGEST


def test_quality_in_blocks_equals_all_passages_at_once():
    draw = np.random.RandomState(3)
    texts = [b"", b"a short text", bytes(draw.randint(97, 123, 40_000, dtype=np.uint8)), b"word " * 9_000, b"x"]
    model = quality.fit([t + b" and more" for t in texts] + [b"THE OTHER %% " * 50] * 5, np.array([0] * 5 + [1] * 5), 0.5)
    bags = [quality.encode_passages(list(quality.passages(t))) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    whole = model.forward(np.concatenate(bags), starts)["score"]
    assert np.allclose(model.score(texts), whole, rtol=0, atol=1e-12)
    assert np.allclose([model.score([t])[0] for t in texts], whole, rtol=0, atol=1e-12)
