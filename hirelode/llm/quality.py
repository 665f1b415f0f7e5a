"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every passage is encoded from the counts of its pairs of character classes and two measures of
repetition. Gated attention weighs the encoded passages, and the weighted sum gives the score; the
weights of encoder, gates and output are learned together, from labels of whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.llm.common import fold, training_rows, with_columns

#: Bytes of a passage; it ends at the next white space, if one comes soon.
PASSAGE = 640
SLACK = 80
#: Passages that are features at once.
BLOCK = 1_024
#: Labelled documents of either class that the model is fitted on, at most; a documented bound.
SAMPLE_PER_CLASS = 1_500
HIDDEN, GATE = 24, 12
ROUNDS, RATE, BATCH, DECAY, SEED = 40, 4e-3, 64, 1e-4, 11

SYMBOLS = b"\n.,|!%&$*#\"'-/:;()@"


def class_table() -> np.ndarray:
    """The class of each byte: letters by case and vowel, digits, blanks, some symbols, the rest."""
    table = np.zeros(256, dtype=np.int64)
    table[ord("a") : ord("z") + 1] = 1
    table[list(b"aeiou")] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[[32, 9]] = 5
    table[128:192] = 6
    table[192:] = 7
    for i, symbol in enumerate(SYMBOLS):
        table[symbol] = 8 + i
    return table


CLASS = class_table()
CLASSES = 8 + len(SYMBOLS)
FEATURES = CLASSES * CLASSES + 3


def passages(text: bytes) -> Iterator[bytes]:
    """Consecutive pieces of the whole text; the empty text is one empty passage."""
    at = 0
    while at < len(text):
        end = at + PASSAGE
        if end < len(text):
            blank = text.find(b" ", end, end + SLACK)
            end = end if blank < 0 else blank
        yield text[at:end]
        at = end
    if not text:
        yield b""


def encode_passages(pieces: list[bytes]) -> np.ndarray:
    """A row of features per passage: shares of class pairs, share of distinct words, compressibility."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    lengths = np.array([len(p) for p in pieces])
    made = np.zeros((len(pieces), FEATURES), dtype=np.float32)
    if len(data):
        classes = CLASS[data]
        number = np.repeat(np.arange(len(pieces)), lengths)
        same = number[1:] == number[:-1]
        pair = (number[:-1] * CLASSES + classes[:-1]) * CLASSES + classes[1:]
        counts = np.bincount(pair[same], minlength=len(pieces) * CLASSES * CLASSES)
        made[:, :-3] = np.sqrt(counts.reshape(len(pieces), -1) / np.maximum(lengths - 1, 1)[:, None])
    for i, piece in enumerate(pieces):
        words = piece.split()
        made[i, -3] = len(set(words)) / len(words) if words else 0.0
        made[i, -2] = len(zlib.compress(piece, 1)) / (len(piece) + 16)
        made[i, -1] = min(len(piece) / PASSAGE, 1.0)
    return made


@dataclass
class Model:
    """Weights of the encoder, the gates, the attention and the output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (features - self.mean) / self.scale
        hidden = np.tanh(x @ w["encode"] + w["encode_bias"])
        signal = np.tanh(hidden @ w["signal"])
        gate = 1 / (1 + np.exp(-(hidden @ w["gate"])))
        raw = (signal * gate) @ w["attend"]
        counts = np.diff(np.append(starts, len(raw)))
        bag = np.repeat(np.arange(len(starts)), counts)
        power = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        attention = power / np.add.reduceat(power, starts)[bag]
        pooled = np.add.reduceat(attention[:, None] * hidden, starts, axis=0)
        logit = pooled @ w["out"] + w["out_bias"]
        return {"x": x, "hidden": hidden, "signal": signal, "gate": gate, "bag": bag,
                "attention": attention, "pooled": pooled, "score": 1 / (1 + np.exp(-logit))}

    def gradients(self, at: dict[str, np.ndarray], error: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """`error` is the derivative of the loss by the logit, per document."""
        w, bag = self.weights, at["bag"]
        pooled = error[:, None] * w["out"]
        by_attention = np.einsum("ij,ij->i", pooled[bag], at["hidden"])
        mean = np.add.reduceat(at["attention"] * by_attention, starts)
        raw = at["attention"] * (by_attention - mean[bag])
        both = raw[:, None] * w["attend"]
        signal = both * at["gate"] * (1 - at["signal"] ** 2)
        gate = both * at["signal"] * at["gate"] * (1 - at["gate"])
        hidden = at["attention"][:, None] * pooled[bag] + signal @ w["signal"].T + gate @ w["gate"].T
        hidden = hidden * (1 - at["hidden"] ** 2)
        return {
            "encode": at["x"].T @ hidden, "encode_bias": hidden.sum(axis=0),
            "signal": at["hidden"].T @ signal, "gate": at["hidden"].T @ gate,
            "attend": (at["signal"] * at["gate"]).T @ raw,
            "out": at["pooled"].T @ error, "out_bias": error.sum(keepdims=True),
        }

    def score(self, texts: list[bytes]) -> np.ndarray:
        """What `forward` gives, BLOCK passages at a time.

        The attention's maximum, its sum and the weighted passages of each text are carried from block to
        block, so memory does not grow with the length of a text.
        """
        w = self.weights
        top, total = np.full(len(texts), -np.inf), np.zeros(len(texts))
        pooled = np.zeros((len(texts), len(w["out"])))
        for numbers, pieces in blocks(texts):
            hidden = np.tanh((encode_passages(pieces) - self.mean) / self.scale @ w["encode"] + w["encode_bias"])
            raw = (np.tanh(hidden @ w["signal"]) / (1 + np.exp(-(hidden @ w["gate"])))) @ w["attend"]
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            of, counts = numbers[starts], np.diff(np.append(starts, len(numbers)))
            most = np.maximum(top[of], np.maximum.reduceat(raw, starts))
            power, before = np.exp(raw - np.repeat(most, counts)), np.exp(top[of] - most)
            total[of] = total[of] * before + np.add.reduceat(power, starts)
            pooled[of] = pooled[of] * before[:, None] + np.add.reduceat(power[:, None] * hidden, starts, axis=0)
            top[of] = most
        return 1 / (1 + np.exp(-((pooled / total[:, None]) @ w["out"] + w["out_bias"])))


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Passages of all texts in turn, BLOCK at a time, each with the number of its text."""
    numbers, pieces = [], []
    for number, text in enumerate(texts):
        for piece in passages(text):
            numbers.append(number)
            pieces.append(piece)
            if len(pieces) == BLOCK:
                yield np.array(numbers), pieces
                numbers, pieces = [], []
    if pieces:
        yield np.array(numbers), pieces


def fit(texts: list[bytes], labels: np.ndarray, share_of_ones: float) -> Model:
    """Fit on documents with labels 0 and 1; the prior of the output is set to the given share.

    The two classes weigh the same while learning, then the logit moves to the share of ones.
    """
    random = np.random.RandomState(SEED)
    bags = [encode_passages(list(passages(t))) for t in texts]
    every = np.concatenate(bags)
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.02, {
        "encode": random.randn(FEATURES, HIDDEN) / np.sqrt(FEATURES), "encode_bias": np.zeros(HIDDEN),
        "signal": random.randn(HIDDEN, GATE) / np.sqrt(HIDDEN), "gate": random.randn(HIDDEN, GATE) / np.sqrt(HIDDEN),
        "attend": random.randn(GATE) / np.sqrt(GATE), "out": random.randn(HIDDEN) / np.sqrt(HIDDEN),
        "out_bias": np.zeros(1),
    })
    first = {n: np.zeros_like(v) for n, v in model.weights.items()}
    second = {n: np.zeros_like(v) for n, v in model.weights.items()}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    step = 0
    for _ in range(ROUNDS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            features = np.concatenate([bags[i] for i in picked])
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in picked])[:-1]]).astype(np.int64)
            seen = model.forward(features, starts)
            error = (seen["score"] - labels[picked]) * weight[picked] / len(picked)
            step += 1
            for name, gradient in model.gradients(seen, error, starts).items():
                gradient = gradient + DECAY * model.weights[name]
                first[name] += 0.1 * (gradient - first[name])
                second[name] += 0.001 * (gradient**2 - second[name])
                size = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.weights[name] -= size * first[name] / (np.sqrt(second[name]) + 1e-8)
    prior = min(max(share_of_ones, 0.01), 0.99)
    model.weights["out_bias"] = model.weights["out_bias"] + np.log(prior / (1 - prior))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    The sample takes either class alike, so the share of label 1 in all labels is counted apart.
    None if the sample lacks a class.
    """
    rows = training_rows(docs, labels, "quality", per_class)
    marks = np.array([r.label for r in rows])
    if len(set(marks.tolist())) < 2:
        return None
    share = labels.filter(F.col("quality").isNotNull() & (fold() != 0)).agg(F.avg("quality")).first()[0]
    return fit([r.text.encode() for r in rows], marks, float(share))


def score_texts(
    df: DataFrame, model: Model | None, text: str = "text", out: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """Append the quality of every whole text, from 0 to 1: all its passages are weighed.

    A null or empty text is one empty passage and is scored like any other. Without a model (labels
    of one class, or none) every score is 1: nothing is known against any document. Repeated rows
    stay; a column named as the output is replaced. The model travels with the function, it is small.
    """

    def compute(column):
        texts = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
        if model is None:
            return [np.ones(len(texts))]
        made = [model.score(texts[at : at + 64]) for at in range(0, len(texts), 64)]
        return [np.concatenate(made) if made else np.zeros(0)]

    return with_columns(df, [text], {out: "double"}, compute, keep)
