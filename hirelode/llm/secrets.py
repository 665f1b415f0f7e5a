"""Secret scans: fixed patterns, and a character network over every other candidate.

A candidate is a run of key characters that plain words do not look like. The network reads its
characters and those around it, but not the words that name a secret: an embedding, two convolutions and a
maximum over all places. It is trained on all findings of the fixed patterns, as they are and spelled anew
in other alphabets of keys, so that it learns what a key looks like and not which patterns there
are; against them stand the other candidates and runs made of the texts' own words. A curve fitted on rows it
has not seen calibrates its output. The threshold is the highest one that finds the required share of
other rows it has not seen and, for each kind of pattern in turn, of the findings of that kind by
a network trained without it; if no ordinary row it has not seen comes near, half the way down to them.

Where the candidates of a table are few, the network is fitted in one place. Otherwise it starts from a fit
on some of them, and then learns from all: they are dealt into shards, every shard takes the network a pass
further, and the mean of the shards' weights begins the next pass. Curve and threshold come from counts of
logits over all rows that were kept apart.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode.llm.common import least_text, texts_of, with_columns
from hirelode.session import materialize

# The base kinds, in their order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")
CASES = re.compile(r"[a-z][A-Z]|[+/_]")
#: Characters the network reads: before a candidate, of it, and behind.
BEFORE, WITHIN, BEHIND = 24, 48, 16
LENGTH = BEFORE + WITHIN + BEHIND
#: Candidates of either class that are fitted in one place.
SAMPLE_PER_CLASS = 1_500
#: Records of either class that a network starts from, before it learns from all.
START_ROWS = 1_000
#: Passes over all candidates, and rows of a shard.
PASSES, SHARD_ROWS = 3, 4_096
#: A logit is counted in steps of this size.
STEP = 0.01
EMBED, FILTERS, REACH = 6, 12, 5
ROUNDS, RATE, BATCH, SEED = 12, 4e-3, 64, 5
#: Share of unseen findings that the threshold must find, and of findings of a kind left out of training.
RECALL, RECALL_UNSEEN_KIND = 0.95, 0.9
#: A kind with fewer findings than this is not left out to set the threshold.
LEAST_FINDINGS = 20
# Words that name a secret, and alphabets that keys are spelled in.
NAMING = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
KEY_ALPHABETS = (
    "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)
KEY_LENGTHS = (16, 64)
#: Not a character: what stands for a hidden one.
HIDDEN = "\x80"

SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the secret itself begins) of the fixed patterns, by start and kind.

    Matches of a kind are leftmost and do not overlap; those that are too short are dropped after.
    """
    found = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    # A match of HEX is a whole run, so the long ones can be looked for at once.
    found += [(m.start(), 2, m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return [(KINDS[kind], start, end, value) for start, kind, end, value in sorted(found)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters with a digit, or with two changes of case or signs that words lack."""
    return [
        m.span() for m in CANDIDATE.finditer(text)
        if DIGIT.search(m[0]) or len(CASES.findall(m[0])) >= 2
    ]


def split_candidates(text: str) -> tuple[list[tuple], list[tuple[int, int]], list[tuple[int, int]]]:
    """Base spans, candidates that a base span touches, and the others."""
    base = base_spans(text)
    hit, other = [], []
    for span in candidates(text):
        (hit if kinds_of(span, base) else other).append(span)
    return base, hit, other


def kinds_of(span: tuple[int, int], base: list[tuple]) -> set[str]:
    """The kinds of the base spans that touch a candidate."""
    return {kind for kind, s, e, _ in base if span[0] < e and s < span[1]}


def symbols(text: str, start: int, end: int) -> np.ndarray:
    """Rows of character numbers around a candidate, one for each stretch of WITHIN characters of it.

    0 stands for no character, 1 for one beyond ASCII or of a word that names a secret; characters of the
    candidate are marked.
    """
    rows = []
    for at in range(start, end, WITHIN):
        piece = NAMING.sub(lambda m: HIDDEN * len(m[0]), text[max(0, at - BEFORE) : at + WITHIN + BEHIND])
        piece = piece.encode("latin-1", "replace")
        codes = np.frombuffer(piece, dtype=np.uint8).astype(np.int64)
        codes = np.where(codes < 128, codes + 2, 1)
        row = np.zeros((2, LENGTH), dtype=np.int64)
        shift = max(0, BEFORE - at)
        row[0, shift : shift + len(codes)] = codes
        row[1, BEFORE : BEFORE + min(end - at, WITHIN)] = 1
        rows.append(row)
    return np.stack(rows)


@dataclass
class Model:
    """Weights of the network, the calibrating curve and the threshold on its probability."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def forward(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.concatenate([w["embed"][rows[:, 0]], rows[:, 1, :, None].astype(float)], axis=2)
        wide = unfold(x)
        first = np.maximum(wide @ w["first"] + w["first_bias"], 0.0)
        wider = unfold(first)
        second = np.maximum(wider @ w["second"] + w["second_bias"], 0.0)
        place = second.argmax(axis=1)
        most = np.take_along_axis(second, place[:, None, :], axis=1)[:, 0]
        return {"wide": wide, "first": first, "wider": wider, "place": place, "most": most,
                "logit": most @ w["out"] + w["out_bias"][0]}

    def gradients(self, rows: np.ndarray, at: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        most = error[:, None] * w["out"] * (at["most"] > 0)
        second = np.zeros((len(rows), at["wider"].shape[1], FILTERS))
        np.put_along_axis(second, at["place"][:, None, :], most[:, None, :], axis=1)
        first = fold_back(second @ w["second"].T, FILTERS) * (at["first"] > 0)
        x = fold_back(first @ w["first"].T, EMBED + 1)[:, :, :EMBED]
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, rows[:, 0], x)
        return {
            "embed": embed, "first": np.einsum("nlk,nlf->kf", at["wide"], first), "first_bias": first.sum((0, 1)),
            "second": np.einsum("nlk,nlf->kf", at["wider"], second), "second_bias": second.sum((0, 1)),
            "out": at["most"].T @ error, "out_bias": error.sum(keepdims=True),
        }

    def logits(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Of a candidate of several stretches the highest."""
        if not spans:
            return np.zeros(0)
        rows = [symbols(text, *span) for span in spans]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        flat = np.concatenate(rows)
        made = np.concatenate([self.forward(flat[at : at + 256])["logit"] for at in range(0, len(flat), 256)])
        return np.maximum.reduceat(made, starts)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def unfold(x: np.ndarray) -> np.ndarray:
    """The values around each place side by side: (n, length, channels) to (n, length, reach * channels)."""
    edge = REACH // 2
    padded = np.pad(x, ((0, 0), (edge, edge), (0, 0)))
    return np.concatenate([padded[:, i : i + x.shape[1]] for i in range(REACH)], axis=2)


def fold_back(wide: np.ndarray, channels: int) -> np.ndarray:
    """The transpose of `unfold`."""
    n, length, _ = wide.shape
    edge = REACH // 2
    padded = np.zeros((n, length + 2 * edge, channels))
    for i in range(REACH):
        padded[:, i : i + length] += wide[:, :, i * channels : (i + 1) * channels]
    return padded[:, edge : edge + length]


def start_weights(random: np.random.RandomState) -> dict[str, np.ndarray]:
    return {
        "embed": 0.5 * random.randn(130, EMBED),
        "first": random.randn(REACH * (EMBED + 1), FILTERS) * np.sqrt(2 / (REACH * (EMBED + 1))),
        "first_bias": np.zeros(FILTERS),
        "second": random.randn(REACH * FILTERS, FILTERS) * np.sqrt(2 / (REACH * FILTERS)),
        "second_bias": np.zeros(FILTERS),
        "out": random.randn(FILTERS) / np.sqrt(FILTERS), "out_bias": np.zeros(1),
    }


def calibrate(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the curve that turns logits into probabilities, by gradient steps."""
    slope, shift = 1.0, 0.0
    for _ in range(2_000):
        error = 1 / (1 + np.exp(-np.clip(slope * logits + shift, -30, 30))) - labels
        slope -= 0.05 * (np.average(error * logits, weights=counts) + 1e-3 * (slope - 1.0))
        shift -= 0.05 * np.average(error, weights=counts)
    return max(slope, 0.05), shift


def respelled(text: str, start: int, end: int, random: np.random.RandomState) -> np.ndarray:
    """A finding's surroundings with another key in its place: any length and alphabet of keys, at times a prefix."""
    letters = list(KEY_ALPHABETS[random.randint(len(KEY_ALPHABETS))])
    key = "".join(random.choice(letters, random.randint(KEY_LENGTHS[0], KEY_LENGTHS[1] + 1)))
    if random.random_sample() < 0.3:
        key = "".join(random.choice(list(KEY_ALPHABETS[0][10:] + "klpst"), random.randint(2, 5))) + "_-"[random.randint(2)] + key
    before = text[max(0, start - BEFORE) : start]
    return symbols(before + key + text[end : end + BEHIND], len(before), len(before) + len(key))[0]


def run_of_words(text: str, start: int, end: int, random: np.random.RandomState) -> np.ndarray | None:
    """Words of the text put together as names, paths and addresses are, with a number now and then."""
    words = re.findall("[A-Za-z]{2,}", text[max(0, start - 400) : end + 400])
    if len(words) < 2:
        return None
    few = [words[i] for i in random.randint(len(words), size=random.randint(2, 6))]
    joint = ("-", "_", ".", "/", "")[random.randint(5)]
    name = joint.join(few) if joint else "".join(w.capitalize() for w in few)
    if random.random_sample() < 0.5:
        name += ("-", "_", ".", "")[random.randint(4)] + str(random.randint(10_000))
    before = text[max(0, start - BEFORE) : start]
    return symbols(before + name + text[end : end + BEHIND], len(before), len(before) + len(name))[0]


def learned(
    rows: np.ndarray, labels: np.ndarray, random: np.random.RandomState,
    start: dict[str, np.ndarray] | None = None, rounds: int = ROUNDS,
) -> Model:
    """A network trained on rows of symbols, from the given weights if any, not yet calibrated."""
    model = Model(start_weights(random) if start is None else {n: v.copy() for n, v in start.items()})
    first = {n: np.zeros_like(v) for n, v in model.weights.items()}
    second = {n: np.zeros_like(v) for n, v in model.weights.items()}
    learn, step = np.arange(len(rows)), 0
    for _ in range(rounds):
        random.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            picked = learn[at : at + BATCH]
            seen = model.forward(rows[picked])
            error = (1 / (1 + np.exp(-np.clip(seen["logit"], -30, 30))) - labels[picked]) / len(picked)
            step += 1
            for name, gradient in model.gradients(rows[picked], seen, error).items():
                first[name] += 0.1 * (gradient - first[name])
                second[name] += 0.001 * (gradient**2 - second[name])
                size = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.weights[name] -= size * first[name] / (np.sqrt(second[name]) + 1e-8)
    return model


def probabilities(model: Model, rows: np.ndarray) -> np.ndarray:
    made = [model.probability(model.forward(rows[at : at + 256])["logit"]) for at in range(0, len(rows), 256)]
    return np.concatenate(made) if made else np.zeros(0)


def reaching(found: np.ndarray, share: float) -> float:
    """The highest threshold that at least this share of the probabilities reaches."""
    if not len(found):
        return 1.0
    return float(np.sort(found)[::-1][int(np.ceil(share * len(found))) - 1])


@dataclass
class Samples:
    """Rows of symbols: findings with their kinds, their respelled copies, and ordinary candidates."""

    findings: np.ndarray
    kinds: list[frozenset]
    copies: np.ndarray
    ordinary: np.ndarray


def samples(texts: list[str], random: np.random.RandomState) -> Samples | None:
    """Candidates of the texts, up to SAMPLE_PER_CLASS of either class; None if either has too few."""
    findings, kinds, copies, other, names = [], [], [], [], []
    for text in texts:
        base, hit, rest = split_candidates(text)
        for span in hit[: SAMPLE_PER_CLASS - len(findings)]:
            findings.append(symbols(text, *span)[0])
            kinds.append(frozenset(kinds_of(span, base)))
            copies.append(respelled(text, *span, random))
            made = run_of_words(text, *span, random)
            names += [] if made is None else [made]
        for span in rest[: SAMPLE_PER_CLASS - len(other)]:
            other.append(symbols(text, *span)[0])
    if min(len(findings), len(other)) < 10:
        return None
    return Samples(np.stack(findings), kinds, np.stack(copies), np.stack(other + names))


def between(reached: float, ordinary: np.ndarray) -> float:
    """Half way, in log-odds, from the highest ordinary probability up to a threshold above it.

    The threshold is the highest that finds enough; where nothing ordinary comes near it, a lower one
    finds more at no cost. It stays where it is if something does.
    """
    top = float(ordinary.max()) if len(ordinary) else reached
    if not 0 < top < reached:
        return reached
    odds = [np.log(p / (1 - p)) for p in np.clip([top, reached], 1e-9, 1 - 1e-9)]
    return float(1 / (1 + np.exp(-sum(odds) / 2)))


def calibrated(
    found: Samples, use: np.ndarray, random: np.random.RandomState
) -> tuple[Model, np.ndarray, np.ndarray]:
    """A network trained on the findings marked in `use`, and the probabilities of findings and of ordinary
    candidates that it has not seen.

    Of findings and ordinary candidates eight tenths are learned from, with the copies; a tenth fits the
    curve, and the last sets thresholds.
    """
    places, plain = random.permutation(np.flatnonzero(use)), random.permutation(len(found.ordinary))
    a, b = len(places) // 10, len(plain) // 10
    held, curve, learn = places[:a], places[a : 2 * a], places[2 * a :]
    rows = np.concatenate([found.findings[learn], found.copies[learn], found.ordinary[plain[2 * b :]]])
    labels = np.repeat([1.0, 0.0], [2 * len(learn), len(plain) - 2 * b])
    model = learned(rows, labels, random)
    rows = np.concatenate([found.findings[curve], found.copies[curve], found.ordinary[plain[b : 2 * b]]])
    labels = np.repeat([1.0, 0.0], [2 * len(curve), b])
    logits = np.concatenate([model.forward(rows[at : at + 256])["logit"] for at in range(0, len(rows), 256)] or [np.zeros(0)])
    if len(logits):
        model.slope, model.shift = calibrate(logits, labels)
    unseen = np.concatenate([found.findings[held], found.copies[held]])
    return model, probabilities(model, unseen), probabilities(model, found.ordinary[plain[:b]])


def fit(texts: list[str], hidden: str | None = None) -> Model | None:
    """Train on the candidates of the texts; None if findings or other candidates are too few.

    A candidate that a base span touches is a finding. With `hidden` the findings of that kind of pattern
    are left out, as if it were not known.
    """
    random = np.random.RandomState(SEED)
    found = samples(texts, random)
    if found is None:
        return None
    known = np.array([hidden not in kinds for kinds in found.kinds])
    if known.sum() < 10:
        return None
    model, unseen, ordinary = calibrated(found, known, random)
    thresholds = [reaching(unseen, RECALL)]
    for kind in KINDS[:3]:
        of_kind = known & np.array([kind in kinds for kinds in found.kinds])
        if kind != hidden and of_kind.sum() >= LEAST_FINDINGS and (known & ~of_kind).sum() >= LEAST_FINDINGS:
            without, _, _ = calibrated(found, known & ~of_kind, random)
            thresholds.append(reaching(probabilities(without, found.findings[of_kind]), RECALL_UNSEEN_KIND))
    model.threshold = between(min(thresholds), ordinary)
    return model


#: What a record is: a label, the kinds of the base spans as bits, a part in 0 to 9, and symbols.
ORDINARY, FINDING, COPY, WORDS = range(4)
#: The parts of unseen rows and of those that fit the curve; the others are learned from.
HELD, CURVE = 0, 1
RECORD = 3 + 2 * LENGTH


def records(text: str) -> bytes:
    """All candidates of a text, each finding with its copy and its run of words, as records one after the other."""
    base, hit, rest = split_candidates(text)
    if not hit and not rest:
        return b""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    random, made = np.random.RandomState(seed), []

    def add(label: int, kinds: set[str], number: int, row: np.ndarray | None) -> None:
        if row is not None:
            part = zlib.crc32(f"{seed}:{number}".encode()) % 10
            bits = sum(1 << KINDS.index(kind) for kind in kinds)
            made.append(bytes((label, bits, part)) + row.astype(np.uint8).tobytes())

    for number, span in enumerate(hit):
        kinds = kinds_of(span, base)
        add(FINDING, kinds, number, symbols(text, *span)[0])
        add(COPY, kinds, number, respelled(text, *span, random))
        add(WORDS, set(), number, run_of_words(text, *span, random))
    for number, span in enumerate(rest, len(hit)):
        add(ORDINARY, set(), number, symbols(text, *span)[0])
    return b"".join(made)


@dataclass
class Records:
    """Records as arrays."""

    label: np.ndarray
    kinds: np.ndarray
    part: np.ndarray
    rows: np.ndarray

    @property
    def secret(self) -> np.ndarray:
        return (self.label == FINDING) | (self.label == COPY)

    @classmethod
    def of(cls, values) -> Records:
        flat = np.frombuffer(b"".join(map(bytes, values)), dtype=np.uint8).reshape(-1, RECORD)
        rows = flat[:, 3:].reshape(-1, 2, LENGTH).astype(np.int64)
        return cls(flat[:, 0], flat[:, 1].astype(int), flat[:, 2], rows)

    def learnable(self, hidden: int) -> np.ndarray:
        """Those that a network learns from which is not shown the kinds of these bits."""
        return (self.part > CURVE) & (self.kinds & hidden == 0)


def flattened(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in sorted(weights)])


def shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[n].size for n in sorted(like)])
    return {n: part.reshape(like[n].shape) for n, part in zip(sorted(like), np.split(flat, ends[:-1]), strict=True)}


def passed(rows: DataFrame, shards: int, networks: dict[int, dict[str, np.ndarray]], number: int) -> dict[int, dict[str, np.ndarray]]:
    """The networks, by the kinds they are not shown, after one more pass over all rows."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["order", "at"])
        found, shard, made = Records.of(pieces["record"]), int(pieces["shard"].iloc[0]), []
        for hidden, start in networks.items():
            use = found.learnable(hidden)
            if use.any():
                random = np.random.RandomState((SEED, number, shard))
                labels = found.secret[use].astype(float)
                model = learned(found.rows[use], labels, random, start, rounds=1)
                made.append((hidden, shard, int(use.sum()), flattened(model.weights).tobytes()))
        return pd.DataFrame(made, columns=["hidden", "shard", "n", "weights"])

    dealt = rows.select("order", "at", "record", F.pmod(F.xxhash64("order", "at"), F.lit(shards)).alias("shard"))
    done = dealt.groupBy("shard").applyInPandas(run, "hidden int, shard bigint, n bigint, weights binary").collect()
    after = {}
    for hidden, start in networks.items():
        parts = sorted((r.shard, r.n, bytes(r.weights)) for r in done if r.hidden == hidden)
        mean = np.average([np.frombuffer(w) for _, _, w in parts], axis=0, weights=[n for _, n, _ in parts]) if parts else flattened(start)
        after[hidden] = shaped(mean, start)
    return after


def counted_logits(rows: DataFrame, networks: dict[int, dict[str, np.ndarray]]) -> pd.DataFrame:
    """How many logits of a network lie in a step: of rows kept apart, and of findings of a kind it was not shown."""

    def run(batches):
        for batch in batches:
            found, made = Records.of(batch["record"]), []
            for hidden, weights in networks.items():
                shown = found.kinds & hidden == 0
                for use, what in ((found.part <= CURVE) & shown, "apart"), ((found.label == FINDING) & ~shown, "unseen"):
                    if use.any():
                        rows_, model = found.rows[use], Model(weights)
                        logits = np.concatenate([model.forward(rows_[at : at + 256])["logit"] for at in range(0, len(rows_), 256)])
                        steps = np.floor(np.clip(logits, -40, 40) / STEP).astype(int)
                        frame = pd.DataFrame({"step": steps, "part": found.part[use].astype(int), "finding": found.secret[use]})
                        if what == "unseen":
                            frame["part"] = -1
                        made.append(frame.groupby(["part", "finding", "step"]).size().rename("n").reset_index().assign(hidden=hidden))
            if made:
                yield pd.concat(made)[["hidden", "part", "finding", "step", "n"]]

    made = rows.select("record").mapInPandas(run, "hidden int, part int, finding boolean, step int, n bigint")
    return made.groupBy("hidden", "part", "finding", "step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")


def byte_of(place: int) -> Column:
    return F.conv(F.hex(F.substring("record", place, 1)), 16, 10).cast("int")


def fit_all(rows: DataFrame, findings: int, of_kind: dict[str, int], total: int) -> Model:
    """Train on all records of a table (order, at, record): counts of findings and of each kind, and of all records."""
    first = Records.of([
        r.record for labels in ((FINDING, COPY), (ORDINARY, WORDS))
        for r in rows.filter(byte_of(1).isin(*labels)).orderBy("order", "at").limit(START_ROWS).collect()
    ])
    # A network that has seen all kinds, and for each kind with enough findings one that has not.
    left_out = [k for k in KINDS[:3] if of_kind[k] >= LEAST_FINDINGS and findings - of_kind[k] >= LEAST_FINDINGS]
    networks = {}
    for hidden in (0, *(1 << KINDS.index(kind) for kind in left_out)):
        use = first.learnable(hidden)
        networks[hidden] = learned(
            first.rows[use], first.secret[use].astype(float), np.random.RandomState(SEED)
        ).weights
    shards = -(-total // SHARD_ROWS)
    for number in range(PASSES):
        networks = passed(rows, shards, networks, number)
    counts, thresholds, main = counted_logits(rows, networks), [], None
    for hidden, weights in networks.items():
        model, own = Model(weights), counts[counts.hidden == hidden]
        curve = own[own.part == CURVE]
        if len(curve):
            model.slope, model.shift = calibrate((curve.step.values + 0.5) * STEP, curve.finding.values.astype(float), curve.n.values)
        met = own[own.finding & (own.part == (-1 if hidden else HELD))]
        share = RECALL_UNSEEN_KIND if hidden else RECALL
        if len(met):
            above = met.n.values[::-1].cumsum()
            step = met.step.values[::-1][np.searchsorted(above, share * above[-1])]
            thresholds.append(float(model.probability(np.array([step * STEP]))[0]))
        if not hidden:
            main, plain = model, own[~own.finding & (own.part == HELD)]
            ordinary = model.probability((plain.step.values + 1) * STEP)
    main.threshold = between(min(thresholds, default=1.0), ordinary)
    return main


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on the candidates of all documents; None if findings or other candidates are too few.

    Of rows that share a key one counts, that of the smallest hash of its text. Few candidates are fitted in
    one place, more of them in passes over shards.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    keyed = keyed.filter(F.col("text").rlike(r"[A-Za-z0-9+/_.-]{12,}")).select(
        F.xxhash64("key").alias("order"), "key", F.xxhash64("text").alias("hash"), "text"
    )
    found = with_columns(
        keyed, ["text"], {"records": "binary"}, lambda column: [[records(t) for t in texts_of(column)]], ["order", "key", "hash"]
    )
    one = found.groupBy("order", "key").agg(F.min(F.struct("hash", "records"))["records"].alias("records"))
    pieces = f"transform(sequence(0, length(records) div {RECORD} - 1), i -> substring(records, int(i * {RECORD} + 1), {RECORD}))"
    rows = materialize(
        one.filter("length(records) > 0").select("order", "key", F.posexplode(F.expr(pieces)).alias("at", "record"))
    )
    finding = byte_of(1) == FINDING
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(finding).alias("findings"),
        F.count_if(byte_of(1) == ORDINARY).alias("ordinary"),
        *[F.count_if(finding & (F.bit_get(byte_of(2), F.lit(i)) == 1)).alias(k) for i, k in enumerate(KINDS[:3])],
    ).first()
    if max(counted.findings, counted.ordinary) > SAMPLE_PER_CLASS:
        if min(counted.findings, counted.ordinary) < 10:
            return None
        return fit_all(rows, counted.findings, {k: counted[k] for k in KINDS[:3]}, counted.total)
    # So few that all their texts can be held.
    ids = rows.select("key").distinct()
    texts = keyed.join(F.broadcast(ids), "key").groupBy("order", "key").agg(least_text().alias("text")).collect()
    return fit([r.text for r in sorted(texts, key=lambda r: (r.order, r.text))])


def spans_of(text: str, model: Model | None) -> list[tuple[str, int, int, int]]:
    """All spans by start, then kind: base spans stay, the network adds candidates they do not touch."""
    base, _, other = split_candidates(text)
    if model is None or not other:
        return base
    sure = model.probability(model.logits(text, other)) >= model.threshold
    added = [(KINDS[3], s, e, s) for (s, e), good in zip(other, sure, strict=True) if good]
    return sorted(base + added, key=lambda span: (span[1], KINDS.index(span[0])))


def find_secrets(
    df: DataFrame, model: Model | None, text: str = "text", out: str = "secrets", keep: list[str] | None = None
) -> DataFrame:
    """Append the spans of secrets in every whole text: kind, start, end, and where the value begins.

    Places count characters, the end is exclusive. A null or empty text has none. Without a model only
    the fixed patterns count. Repeated rows stay; a column named as the output is replaced.
    """

    def compute(column):
        return [[
            [dict(zip(("kind", "start", "end", "value"), span, strict=True)) for span in spans_of(t, model)]
            for t in texts_of(column)
        ]]

    return with_columns(df, [text], {out: SPANS}, compute, keep)


def redacted(text: str, spans: list[tuple[str, int, int, int]], mask: str) -> str:
    parts, at = [], 0
    for start, end in sorted((value, end) for _, _, end, value in spans):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mask]
        at = end
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, model: Model | None, text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """Replace the values of secrets in every whole text; the word that names one stays.

    All rows and columns stay, and texts without secrets, null among them, stay as they are.
    """

    def compute(column):
        made = []
        for value in column.to_pylist():
            spans = spans_of(value, model) if value else []
            made.append(redacted(value, spans, mask) if spans else value)
        return [made]

    return with_columns(df, [text], {text: "string"}, compute).select(*[f"`{c}`" for c in df.columns])
