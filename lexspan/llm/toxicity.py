"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetch, map_text, materialize
from .quality import labelled_sample

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The feature space; weights that L1 leaves are at most this many, so the broadcast is at most 4 MB.
SPACE_BITS = 19
#: Most labelled documents that the weights are fitted on, chosen by hash of doc_id.
MOST_LABELLED = 12_000
PART = 1 << 16


def features(text: bytes | None, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed words, word pairs and pairs with one word skipped of a whole text, A-Z lower-cased.

    ``keep`` (a mask) leaves out the features without a weight before they are made distinct.
    """
    words, found = TOKEN.findall(text.lower()) if text else [], []
    shift = np.uint64(64 - SPACE_BITS)
    for i in range(0, len(words), PART):
        h = np.fromiter(map(zlib.crc32, words[max(0, i - 2) : i + PART]), np.uint64) + np.uint64(1)
        own = min(i, 2)  # words of the part before, here only for their pairs
        for mixed in (
            h[own:] * np.uint64(0x9E3779B97F4A7C15),
            (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9))[max(0, own - 1) :],
            (h[:-2] * np.uint64(0x27D4EB2F165667C5) + h[2:] * np.uint64(0x85EBCA77C2B2AE63)),
        ):
            ids = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
            found.append(ids if keep is None else ids[keep[ids]])
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


class Ftrl:
    """Weights of FTRL-proximal (McMahan et al., KDD 2013): per-coordinate rates, exact zeros by L1.

    ``weight`` multiplies the gradient of the rarer label 1.
    """

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 16.0, l2: float = 0.1, weight: float = 3.0):
        self.alpha, self.beta, self.l1, self.l2, self.weight = alpha, beta, l1, l2, weight
        self.z, self.n = np.zeros(1 + (1 << SPACE_BITS)), np.zeros(1 + (1 << SPACE_BITS))  # the last one is the bias

    def weights(self, at) -> np.ndarray:
        z, free = self.z[at], (np.abs(self.z[at]) > self.l1) | (np.asarray(at) == len(self.z) - 1)
        return np.where(free, -(z - np.sign(z) * np.where(np.asarray(at) == len(self.z) - 1, 0, self.l1)) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * (self.weight if label else 1)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


class Model:
    """The non-zero weights, as sorted places and values, and the bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at.astype(np.int32), weight.astype(np.float32), float(bias)

    def start(self):
        dense = np.zeros(1 << SPACE_BITS, np.float64)
        dense[self.at] = self.weight
        keep = dense != 0

        def work(texts: list[bytes | None]) -> np.ndarray:
            logits = np.array([dense[features(x, keep)].sum() for x in texts]) + self.bias
            return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

        return work


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", most: int = MOST_LABELLED, epochs: int = 8, seed: int = 3) -> Model:
    """Learn from at most ``most`` labelled rows, in an order given by ``seed``.

    Features are computed where the texts are; the driver gets hashed features of the bounded sample only.
    Without labels every text scores 1/2; with one class the bias alone learns it.
    """
    sample = F.broadcast(materialize(labelled_sample(labels, label, most)))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(sample, "doc_id")
    got = map_text(rows, lambda: lambda texts: {"x": [features(t) for t in texts]}, "x array<int>", ["doc_id", "label"])
    got = fetch(got)
    got = got.iloc[np.lexsort((got["x"].map(len), got["doc_id"]))]
    x, y, model = [np.asarray(v, np.int64) for v in got["x"]], got["label"].to_numpy(float), Ftrl()
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in r.permutation(len(x)):
            model.learn(x[k], y[k])
    every = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(every[:-1])
    return Model(at, every[at], every[-1])


def classify(docs: DataFrame, model: Model, carry: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` to every row.

    Null and empty texts have no feature and get the bias's score. Repeated words and repeated rows change nothing; a tie with the threshold counts as 1. Input columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = shared.value.start()

        def work(texts: list[bytes | None]) -> dict[str, np.ndarray]:
            found = score(texts)
            return {"score": found, "predicted": (found >= threshold).astype(np.int32)}

        return work

    return map_text(docs, start, "score double, predicted int", carry, text)
