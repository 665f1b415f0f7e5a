"""Toxicity by compression distance with zstandard dictionaries.

One dictionary is trained on ordinary text and one on toxic text. A window of text is compressed
with the ordinary dictionary, and with both, the toxic one ahead of it: the bytes saved say how much
the window shares with toxic text that ordinary text does not explain. Since labels are of whole
documents, of which toxic words are a small part, the toxic dictionary is trained on the words and
word beginnings that toxic documents hold far more often than ordinary ones. The savings of all
windows become a score by a logistic curve fitted on documents that no dictionary was trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from hirelode.llm.common import training_rows, with_columns

#: Bytes of a window; it ends at the next white space, if one comes soon.
WINDOW, SLACK = 96, 40
#: Labelled documents of either class that are learned from, at most; a documented bound.
SAMPLE_PER_CLASS = 1_500
ORDINARY_SIZE, TOXIC_SIZE = 110_000, 2_048
LEVEL = 12
#: Share of the sample that the dictionaries learn from; the rest calibrates the score.
LEARN = 0.6
#: A word or beginning tells if this share of toxic documents has it, so many times the ordinary share.
TELLING_SHARE, TELLING_RATIO, TELLING_LEAST = 0.015, 10.0, 4
BEGINNINGS = (4, 5, 6)
HEAD = 5


#: Small letters; white space, punctuation and digits, in any number, only part words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())
#: White space beyond ASCII, as UTF-8.
BLANKS = re.compile(rb"\xc2[\x85\xa0]|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe3\x80\x80|\xef\xbb\xbf")


def marked(text: bytes) -> bytes:
    """The words of a text between single blanks, small but for the ASCII letters among the first bytes of each:
    large there, so that a word's beginning is not matched by the same letters inside another."""
    words = BLANKS.sub(b" ", text).translate(LETTERS).split()
    return b" ".join([b"", *[w[:HEAD].upper() + w[HEAD:] for w in words], b""]) if words else b""


def windows(text: bytes) -> list[bytes]:
    """Consecutive pieces of the whole marked text; a text without words is one empty window."""
    text = marked(text)
    pieces, at = [], 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            blank = text.find(b" ", end, end + SLACK)
            end = end if blank < 0 else blank
        pieces.append(text[at:end])
        at = end
    return pieces or [b""]


def beginnings(word: bytes) -> set[bytes]:
    return {word} | {word[:n] for n in BEGINNINGS if len(word) > n}


def shares(texts: list[bytes]) -> Counter:
    """In how many of the texts each word and word beginning occurs."""
    counts: Counter = Counter()
    for text in texts:
        counts.update({b for w in set(marked(text).split()) for b in beginnings(w)})
    return counts


def telling_samples(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Every occurrence of a telling word or beginning in the toxic texts."""
    often, seldom = shares(toxic), shares(ordinary)
    least = max(TELLING_LEAST, TELLING_SHARE * len(toxic))
    telling = {
        w for w, n in often.items()
        if n >= least and n / len(toxic) > TELLING_RATIO * (seldom[w] + 1) / len(ordinary)
    }
    samples = []
    for text in toxic:
        for word in marked(text).split():
            if known := beginnings(word) & telling:
                longest = max(known, key=len)
                samples.append(b" " + longest + (b" " if longest == word else b""))
    return samples


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; where they are too few to train on, the samples themselves, those
    that occur most often last: zstandard reaches the end of a dictionary best, so the start gives way."""
    distinct = [s for s, _ in sorted(Counter(samples).items(), key=lambda c: (c[1], c[0]))]
    try:
        made = zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        made = b""
    return made if any(s.strip() in made for s in distinct if s.strip()) else b"".join(distinct)[-size:]


@dataclass
class Model:
    """Two dictionaries and the curve; compressors are made anew where the model arrives."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    _pair: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "_pair": []}

    def saved(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves, per window."""
        if not self._pair:
            for content in (self.ordinary, self.toxic + self.ordinary):
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(
                    dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress)
        plain, both = self._pair
        return np.array([len(plain(p)) - len(both(p)) for p in pieces], dtype=np.float64)

    def features(self, text: bytes) -> np.ndarray:
        saved = np.sort(self.saved(windows(text)))[::-1]
        gain = np.maximum(saved, 0.0)
        return np.array([
            1.0, min(gain[0], 12.0), min(gain[1], 12.0) if len(gain) > 1 else 0.0, np.log1p(gain.sum()),
            gain.mean(), (saved >= 2).mean(), np.log1p((saved >= 2).sum()), np.log(len(saved)),
        ])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        made = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(made @ self.weights, -30, 30)))


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic curve, by Newton's method.

    The rarer class counts more, by the root of how much rarer it is: half way to equal weights.
    """
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    worth = np.where(labels == 1, np.sqrt((1 - share) / share), 1.0)
    weights = np.zeros(features.shape[1])
    keep = ridge * np.eye(features.shape[1])
    for _ in range(50):
        score = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (worth * (score - labels)) + keep @ weights
        bend = (features * (worth * score * (1 - score))[:, None]).T @ features + keep
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Train dictionaries and curve; equal texts count once. Without both labels every score is 0."""
    distinct = dict(zip(texts, labels.tolist(), strict=True))
    toxic = [t for t, y in distinct.items() if y == 1]
    plain = [t for t, y in distinct.items() if y == 0]
    if len(toxic) < 2 or len(plain) < 2:
        return Model(b"", b"", np.zeros(0))
    of_toxic, of_plain = max(1, int(LEARN * len(toxic))), max(1, int(LEARN * len(plain)))
    ordinary = trained(ORDINARY_SIZE, [w for t in plain[:of_plain] for w in windows(t)])
    samples = telling_samples(toxic[:of_toxic], plain[:of_plain])
    model = Model(ordinary, trained(TOXIC_SIZE, samples) if samples else b"", np.zeros(0))
    rest = toxic[of_toxic:] + plain[of_plain:]
    held = np.array([1] * (len(toxic) - of_toxic) + [0] * (len(plain) - of_plain))
    features = np.array([model.features(t) for t in rest])
    return Model(model.ordinary, model.toxic, logistic(features, held))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    rows = training_rows(docs, labels, "toxic", per_class)
    return fit([r.text.encode() for r in rows], np.array([r.label for r in rows]))


def score_texts(
    df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """Append the toxicity of every whole text, from 0 to 1.

    All windows of a text count, of any length. Null, empty and blank texts are scored like a text
    without toxic words. Repeated rows stay; a column named as the output is replaced. The model
    travels with the function: two dictionaries of bounded size.
    """

    def compute(column):
        return [model.score([v or b"" for v in column.cast(pa.binary()).to_pylist()])]

    return with_columns(df, [text], {out: "double"}, compute, keep)
