"""Spelling variants, the filter audit and decontamination against plain versions."""

import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import pytest

from hirelode.llm import decontamination, filter_audit, queries, spelling
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling variants


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts: dict[str, int], ratio: int = 5) -> set:
    rows = {}
    for word, n in counts.items():
        others = [o for o in counts if o != word and near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o.encode("utf-32-be")), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[word] = (form, len(others))

    def root(word):
        return word if rows[word][0] is None else root(rows[word][0])

    return {(w, f, root(w), counts[w], k, counts.get(f)) for w, (f, k) in rows.items()}


def read_variants(rows) -> set:
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_equal_all_pairs(spark):
    random.seed(3)
    counts = {"": 9, "a": 60, "aa": 2, "aaa": 400, "aab": 1, "baa": 81, "é": 3, "日本": 16, "日": 3, "日本語": 700, "a$b": 4, "$": 1}
    while len(counts) < 400:
        counts["".join(random.choices("abé", k=random.randint(1, 7)))] = random.choice([1, 2, 5, 5, 25, 126, 700, 4_000])
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, root string")
    rows = spelling.variants(df).collect()
    assert len(rows) == len(counts)
    assert read_variants(rows) == plain_variants(counts)


def test_long_chains_reach_their_root(spark):
    counts = {"x" * 8 + "y" * i: 5 ** (i + 1) for i in range(14)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = spelling.variants(df).collect()
    assert {r.root for r in rows} == {"x" * 8 + "y" * 13}
    assert read_variants(rows) == plain_variants(counts)


def test_variants_take_odd_rows(spark):
    df = spark.createDataFrame([("ab", 1), ("ab", 2), (None, 5), ("ac", None), ("a\x00", 9), ("ad", 15)], "word string, n bigint")
    assert read_variants(spelling.variants(df).collect()) == {("ab", "ad", "ad", 3, 1, 15), ("ad", None, "ad", 15, 1, None)}
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def plain_counts(rows, every: int) -> dict[str, int]:
    counts: dict[str, int] = {}
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run
            if len(word) >= 6:
                counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_words_are_counted_as_stated(spark, edge, empty):
    rows = spark.createDataFrame(
        [(i, "Straße ÄRGERLICH größer Überall×wordword wordwords é-accent", "s") for i in range(60)]
        + [(None, "Überall überall ÜBERALL nothing nothing", "s"), (7, None, "s"), (8, "", "s")],
        "doc_id bigint, text string, word string",
    )
    for df in (rows, edge):
        got = {r.word: r.n for r in spelling.word_counts(df, least_count=2, slip_every=7).collect()}
        assert got == plain_counts([(r.doc_id, r.text) for r in df.collect()], 7)
    assert spelling.word_counts(empty).count() == 0


# The filter audit


def plain_fails(rows) -> list[tuple]:
    """(part, key, fails) of (key, text, part) rows, pair by pair for repeated texts."""
    made = []
    for key, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bits = [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)),
            key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows),
        ]
        made.append((part or "", key, sum(1 << i for i, b in enumerate(bits) if b)))
    return made


def plain_audit(rows, good: set, toxic: set) -> set:
    """Every order is run, filter by filter, over the documents themselves."""
    made, fails = set(), plain_fails(rows)
    for part in {p for p, _, _ in fails}:
        own = [(k, f) for p, k, f in fails if p == part]
        steps, shares = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(k, f) for k, f in left if f & bit]
                left = [(k, f) for k, f in left if not f & bit]
                shares[letter] += len(gone)
                steps.append((
                    part, "".join(order), step, letter, len(left), len(gone), sum(f & bit > 0 for _, f in own) - len(gone),
                    sum(f == bit for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ))
        made |= {(*s, shares[s[3]]) for s in steps}
    return made


def test_audit_equals_running_every_order(spark):
    random.seed(5)
    texts = [
        None, "", "  \n\t ", "Short one", "SHOUTING " * 60, "word " * 60, " ".join(f"w{i}" for i in range(80)),
        " ".join(f"w{i}" for i in range(80)) + " #", " ".join(f"Word{i}" for i in range(49)), "日本 | " * 30, "x" * 120_000,
        " ".join(str(i) for i in range(30_000)),
    ]
    rows = [(random.choice([None, *range(30)]), random.choice(texts), random.choice([None, "", "a", "b", "b"])) for _ in range(120)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, fails string, good int")
    labelled = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in [*range(25), 3, 4, None]]
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int")
    good = {i for i, q, _ in labelled if q == 1 and i is not None}
    toxic = {i for i, _, t in labelled if t == 1 and i is not None}
    found = [tuple(r) for r in filter_audit.audit(filter_audit.tabulate(docs, labels)).collect()]
    expected = plain_audit(rows, good, toxic)
    assert len(found) == len(expected) and set(found) == expected


def test_audit_of_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.audit(filter_audit.tabulate(docs, labels)).collect()
    assert len(rows) == 600 and {r.good_lost for r in rows} == {0}
    assert filter_audit.audit(filter_audit.tabulate(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6])
def test_least_squares_gives_shapley_values(size):
    random.seed(size)
    counts = [random.randint(0, 50) for _ in range(1 << size)]
    removals = filter_audit.coalition_removals(counts, size)
    assert removals == [sum(n for s, n in enumerate(counts) if s & c) for c in range(1 << size)]
    shares = [Fraction(0)] * size
    orders = list(permutations(range(size)))
    for order in orders:
        before = 0
        for i in order:
            shares[i] += Fraction(removals[before | 1 << i] - removals[before], len(orders))
            before |= 1 << i
    assert filter_audit.shapley_values(removals, size) == shares


# Decontamination


def plain_contamination(docs, items, window: int) -> list[tuple]:
    split = lambda t: WORD.findall((t or "").translate(CAPITALS))
    pieces = set()
    for item, text in items:
        words = split(text)
        if item is not None and words:
            n = min(window, len(words))
            pieces |= {(str(item), tuple(words[i : i + n])) for i in range(len(words) - n + 1)}
    made = []
    for key, text in docs:
        words, hit, held = split(text), set(), set()
        for item, piece in pieces:
            for i in range(len(words) - len(piece) + 1):
                if tuple(words[i : i + len(piece)]) == piece:
                    hit |= set(range(i, i + len(piece)))
                    held.add(item)
        made.append((key, len(words), len(hit), tuple(sorted(held))))
    return sorted(made, key=repr)


def read_contamination(rows) -> list[tuple]:
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=repr)


@pytest.mark.parametrize("broadcast", [decontamination.BROADCAST_BYTES, -1])
def test_contamination_equals_every_place(spark, broadcast):
    random.seed(8)
    text = lambda n, letters="aabbcé": " ".join(random.choices(letters, k=n))
    items = [(1, text(14)), (2, text(3)), (20, text(30, "xyz")), (3, "a"), (4, "B, Q!"), (None, "a b"), (5, None), (6, "..."), (7, text(6)), (7, text(6)), (20, "z9z Z9Z")]
    docs = [(i % 25, text(random.randint(0, 60), random.choice(["aabbcé", "xyz", "abq", "z"]))) for i in range(60)]
    docs += [(90, items[0][1]), (91, f"{items[0][1]} {items[0][1]} {items[2][1]}"), (None, items[2][1]), (None, items[2][1]), (92, None)]
    docs += [(93, ""), (94, " \n"), (95, "q B,q,, a"), (96, "Z9Z-z9z")]
    got = decontamination.contamination(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, n_words string"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, doc_id int"), broadcast_bytes=broadcast,
    ).collect()
    assert read_contamination(got) == plain_contamination(docs, items, 10)


def test_contamination_takes_edge_rows(spark, edge, empty):
    items = spark.createDataFrame([(1, "word word word"), (2, "plain words"), (3, "日本 TEXT")], "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    short = [(k, t) for k, t in docs if not t or len(t) < 1_000]
    rows = decontamination.contamination(edge, items).collect()
    assert len(rows) == len(docs)
    long = [r for r in rows if r.n_words > 1_000]
    assert [(r.n_hit, list(r["items"]), len(r.spans)) for r in long] == [(30_000, ["1"], 1)]
    few = [r for r in rows if r.doc_id not in (5, 6)]
    assert read_contamination(few) == plain_contamination([d for d in short if d[0] not in (5, 6)], [(1, "word word word"), (2, "plain words"), (3, "日本 TEXT")], 10)
    assert decontamination.contamination(empty, items).count() == 0
    none = decontamination.contamination(edge, items.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)


def test_decontamination_runs_no_python(spark, plan):
    text = plan(queries.op13_decontamination(spark, SMALL))
    for operator in ("EvalPython", "InPandas", "InArrow", "Cartesian", "NestedLoopJoin"):
        assert operator not in text
