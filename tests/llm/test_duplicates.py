"""SimHash near-duplicates, components and substring de-duplication against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from hirelode.llm import simhash, substring_dedup
from hirelode.llm.components import components
from tests.llm.conftest import EDGE, SCHEMA


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_fingerprint(text, size=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance):
    values = sorted(set(fps))
    array, sets = np.array(values, dtype=np.uint64), Sets(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= distance):
            sets.join(i, int(j))
    return {v: values[sets.find(i)] for i, v in enumerate(values)}


def clustered(seed, centres, each, flips):
    draw, made = random.Random(seed), set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(each):
            value = centre
            for _ in range(draw.randint(0, flips)):
                value ^= 1 << draw.randrange(64)
            made.add(value)
    return sorted(made)


def test_components_of_chains_loops_and_repeats(spark, empty):
    draw = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100), (7, 7), (300, 200), (200, 300), (300, 200), (None, 3)]
    pairs += [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)]
    sets = Sets({n for p in pairs if None not in p and p[0] != p[1] for n in p})
    for a, b in pairs:
        if a is not None and a != b:
            sets.join(a, b)
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {n: sets.find(n) for n in sets.up}
    assert components(edges.limit(0), "a", "b").collect() == []


def test_fingerprints(edge):
    got = simhash.fingerprints(edge).collect()
    assert len(got) == len(EDGE)
    for row in got:
        if row.doc_id not in (5, 6):
            assert row.fp % (1 << 64) == brute_fingerprint(row.text)


def test_long_texts_are_added_up_in_slices(monkeypatch):
    draw = random.Random(6)
    texts = [" ".join(draw.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 3, 40, 200, 7)]
    monkeypatch.setattr(simhash, "SLICE", 16)
    got = simhash.fingerprints_of([t.encode() for t in texts]).tolist()
    assert got == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5, 7])
def test_keys_meet_every_pair_in_reach(distance):
    """Two fingerprints in reach share a key whose start passes all budgets, at every level of splitting."""
    draw = random.Random(distance)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for place in draw.sample(range(64), distance):
            b ^= 1 << place
        x = np.array([a ^ b], dtype=np.uint64)
        keys = [
            (start, mask) for start, mask in simhash.root_keys(distance)
            if a & mask == b & mask and simhash.near(x, np.array([start]), distance)[0]
        ]
        assert keys
        for _, mask in keys:
            assert any(a & m == b & m for m in simhash.refine(mask, distance))


@pytest.mark.parametrize(("distance", "bucket"), [(3, 2_048), (3, 64), (2, 64)])
def test_links_join_exactly_the_classes(spark, distance, bucket):
    fps = clustered(7, 4, 300, 5)
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    found = components(simhash.links(table, distance, bucket), "u", "v", "fp", "root").collect()
    root = {r.fp % (1 << 64): r.root for r in found}
    classes, expected = defaultdict(set), defaultdict(set)
    for f, r in brute_classes(fps, distance).items():
        expected[r].add(f)
        classes[root.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_of_documents(spark, edge, empty):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80).collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(10_000 + r.doc_id, r.text + " more") for r in rows[:20]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_classes(fps.values(), 3)
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    got = simhash.near_duplicates(table).select("*", simhash.hex_digits().alias("digits")).collect()
    assert {r.doc_id: (r.digits, r.component_id) for r in got} == {
        i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()
    }
    of_edge = simhash.near_duplicates(edge).collect()
    assert len(of_edge) == len(EDGE)
    assert {r.component_id for r in of_edge if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in of_edge if r.doc_id in (1, 8)} == {1}
    assert simhash.near_duplicates(empty).collect() == []


def test_one_row_of_each_component_stays(spark, edge, empty):
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    # The text without a key is alone in its component; the blank texts are one, with key 2.
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-1, 1, 2, 5, 6, 7, 9, 9]
    assert simhash.keep_first(empty).collect() == []


PASSAGE = (
    "every copied passage of this length goes on over more than fifty words so that a reader who meets it again in "
    "another document will know at once that one of them was taken from the other and that only the first of them "
    "should be kept while the later ones lose exactly these words and keep whatever else they had to say about it"
)


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghilmnorstu") for _ in range(draw.randint(2, 9))) for _ in range(words))


def test_gear_hash_and_cuts():
    data = np.frombuffer(prose(1, 100).encode(), dtype=np.uint8)
    rolled, gear = substring_dedup.gear_hashes(data), substring_dedup.GEAR.astype(int)
    for i in range(0, len(data), 7):
        window = range(min(substring_dedup.WINDOW, i + 1))
        assert rolled[i] == sum(int(gear[data[i - k]]) << k for k in window) % 65_536
    texts = [t.encode() for t in (prose(2, 500), "", "é" * 700, "x", PASSAGE)]
    number, first, size, _, _ = substring_dedup.chunks_of(texts)
    for i, text in enumerate(texts):
        mine = number == i
        joined = list(zip(first[mine].tolist(), size[mine].tolist(), strict=True))
        at = 0
        for begin, length in joined:
            assert begin == at and 0 < length <= substring_dedup.MOST
            at += length
        assert at == len(text.decode())


def test_repeated_passages_are_found_wherever_they_stand(spark, empty):
    rows = [(i, prose(100 + i, 150), "a") for i in range(40)]
    for i in range(20, 40, 2):
        before, after = prose(200 + i, i), prose(300 + i, 60)
        rows[i] = (i, f"{before} {PASSAGE} {after}", "b")
    rows += [(50, rows[3][1], "copy"), (51, None, None), (52, "", None), (None, PASSAGE, None), (20, rows[20][1], "again")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = substring_dedup.repeated_spans(table).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        text = dict((k, t) for k, t, _ in rows)[r.doc_id]
        assert text[r.start : r.end] in dict((k, t) for k, t, _ in rows)[r.first_doc_id]
    assert set(by_id) == {*range(22, 40, 2), 50}
    assert all(r.first_doc_id == 3 if r.doc_id == 50 else 20 <= r.first_doc_id < r.doc_id for r in got)
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(table).collect()}
    assert 50 not in left and left[20] == rows[20][1] and left[None] == PASSAGE
    assert {51, 52} <= set(left) and left[51] is None and left[52] == ""
    for i in range(40):
        if i % 2 or i <= 20:
            assert left[i] == rows[i][1]
        else:
            shared = set(PASSAGE.split())
            assert len([w for w in left[i].split() if w in shared]) < 35
            for word in left[i].split():
                assert word in rows[i][1].split()
    assert substring_dedup.repeated_spans(empty).collect() == []
    assert substring_dedup.remove_repeats(empty).collect() == []


def planted(seed, passage):
    """The passage within two documents, at places of their own."""
    draw = random.Random(seed)
    return [f"{prose(2 * seed + i, draw.randint(0, 40))} {passage} {prose(2 * seed + i, 90)}" for i in (100_000, 100_001)]


@pytest.mark.parametrize("repetitive", [False, True])
def test_passages_of_just_over_fifty_words_are_found(spark, repetitive):
    """Short words and long ones, and passages that say a few words over and over."""
    draw, pairs = random.Random(11), []
    for i in range(300):
        words = prose(i, 51 + i % 10).split()
        if repetitive:
            words = words[: draw.randint(1, 4)] * len(words)
        passage = " ".join(words[: 51 + i % 10])
        pairs += [(2 * i + j, text, str(i)) for j, text in enumerate(planted(i, passage))]
    got = substring_dedup.repeated_spans(spark.createDataFrame(pairs, SCHEMA)).collect()
    texts = {key: text for key, text, _ in pairs}
    assert {r.doc_id for r in got} >= set(range(1, 600, 2))
    if not repetitive:
        assert {r.doc_id - r.first_doc_id for r in got} == {1}
        assert all(texts[r.doc_id][r.start : r.end] in texts[r.first_doc_id] for r in got)


def test_cuts_depend_on_the_text_alone():
    texts = [t.encode() for t in (prose(3, 90), "ab " * 40, "", "é" * 90, "x" * 500, "short", prose(4, 20))]
    number, first, size, high, low = substring_dedup.chunks_of(texts)
    for i, text in enumerate(texts):
        _, *alone = substring_dedup.chunks_of([text])
        for mine, other in zip((first, size, high, low), alone, strict=True):
            assert mine[number == i].tolist() == other.tolist()
        if len(text) > 100:
            assert max(size[number == i]) <= 3 * substring_dedup.PLACES


def test_edge_rows_of_substrings(edge):
    assert substring_dedup.repeated_spans(edge).collect() == []
    assert substring_dedup.remove_repeats(edge).count() == len(EDGE)


def test_spans_shrink_to_whole_words():
    assert substring_dedup.without("one two three four", [(2, 11)]) == "one  three four"
    assert substring_dedup.without("one two", [(0, 7)]) == ""
    assert substring_dedup.without("onetwothree", [(2, 6)]) == "onetwothree"


def test_text_without_blanks_is_cut_where_the_span_ends(spark):
    draw = random.Random(12)
    signs = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage, spaced, line = signs(300), f"{signs(90)} {signs(200)} {signs(90)}", "%0600x" % draw.getrandbits(2400)
    rows = []
    for i, shared in enumerate((passage, spaced, line)):
        rows += [(10 * i, signs(120) + shared + signs(150), "a"), (10 * i + 1, signs(200) + shared + signs(80), "b")]
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (first, text, _), (later, other, _) in zip(rows[::2], rows[1::2], strict=True):
        shared = len(other) - 280
        assert left[first] == text
        assert left[later].startswith(other[:200]) and left[later].endswith(other[-80:])
        assert len(left[later]) < 280 + shared / 3
    # The blank is nearer than the reach at one end and farther at the other.
    text = "ab cdef" + "x" * 100 + " gh"
    assert substring_dedup.without(text, [(4, 80)]) == text[:4] + text[80:]
    assert substring_dedup.without(text, [(1, 80)]) == "ab " + text[80:]
    assert substring_dedup.without(text, [(4, 109)]) == text[:4] + " gh"


PASSAGE = " ".join(f"passage{i}" for i in range(60))


def test_rows_of_one_key_in_two_components_both_stay(spark):
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, PASSAGE), (1, other), (1, other), (2, PASSAGE), (3, other), (4, "alone of its kind here")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted({(1, PASSAGE), (1, other), (4, "alone of its kind here")})


def test_each_row_loses_the_spans_of_its_own_text(spark):
    plain = " ".join(f"plain{i}" for i in range(100))
    rows = [(1, PASSAGE), (2, f"before it {PASSAGE} and behind"), (2, plain), (2, plain), (3, plain), (5, f"a {PASSAGE}"), (5, None), (5, f"b {PASSAGE} c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, row string")
    spans = substring_dedup.repeated_spans(df).collect()
    texts = {(r.doc_id, r.row) for r in spans}
    assert len(texts) == 4 and {r.doc_id for r in spans} == {2, 3, 5}
    left = sorted((r.doc_id, r.text or "") for r in substring_dedup.remove_repeats(df).collect())
    assert left[0] == (1, PASSAGE) and [t for k, t in left if k == 2].count(plain) == 2
    assert not any(k == 3 for k, _ in left) and (5, "") in left
    assert len(left) == 7 and all(len(t) < 300 for k, t in left if k in (2, 5) and t != plain)


def brute_cuts(data: bytes) -> list[int]:
    """Ends of chunks from the definition: a rolling sum of 16 bytes, cuts at the least of some 32 places."""
    gear = [xxhash.xxh64_intdigest(bytes([b]), seed=7) & 0xFFFF for b in range(256)]
    rolled = {at: sum(gear[data[at - k]] << k for k in range(16)) & 0xFFFF for at in range(15, len(data) - 1)}
    places = sorted(rolled)
    least = set()
    for i in range(len(places) - 31):
        some = places[i : i + 32]
        low = min(rolled[p] for p in some)
        least |= {p for p in some if rolled[p] == low}
    ends, at = [], 0
    for cut in [*sorted(p + 1 for p in least), len(data)]:
        while cut - at > 256:
            at += 256
            ends.append(at)
        if cut - at >= 16 or cut == len(data):
            ends.append(cut)
            at = cut
    return ends


@pytest.mark.parametrize("text", [PASSAGE, "a" * 1_000, "ab " * 300, "short", "x" * 15 + "yz" * 40])
def test_cuts_equal_the_definition(text):
    _, first, size, _, _ = substring_dedup.chunks_of([b"ahead", text.encode(), b"behind"])
    number = substring_dedup.chunks_of([b"ahead", text.encode(), b"behind"])[0]
    made = [int(f + s) for n, f, s in zip(number, first, size, strict=True) if n == 1]
    assert made == brute_cuts(text.encode())


def test_very_many_spans_of_one_document(spark):
    """20,000 separate spans: one pass over their starts, not a fold of a growing list."""
    pieces = [f"{i:06d} " + " ".join(f"{i * 7919 % 10007}w{j}" for j in range(16)) for i in range(20_000)]
    shared = spark.createDataFrame([(1, "\n".join(pieces))], "doc_id bigint, text string")
    mixed = spark.createDataFrame([(2, "\n".join(f"{p} {hash((i, 1)) & 0xFFFFFFFF:x}{i * 31337:x} own{i}tail{i * 17:x}" * 1 for i, p in enumerate(pieces)))], "doc_id bigint, text string")
    found = substring_dedup.repeated_spans(shared.union(mixed), least_span=40)
    assert found.count() > 10_000
