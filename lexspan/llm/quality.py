"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetch, map_text, materialize, utf8

#: Letters and digits (and all non-ASCII characters) make words; other runs are tokens of their own.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
#: Word vectors live in SLOTS hashed rows of DIM dimensions, a bound of 4 MB whatever the vocabulary.
SLOTS, DIM, NONZERO, WINDOW = 1 << 15, 32, 4, 2
#: Most labelled documents that the network is fitted on, chosen by hash of doc_id.
MOST_LABELLED = 20_000
PART = 1 << 16
SIZE = 2 * DIM + 6


def slots(text: bytes) -> Iterator[np.ndarray]:
    """Rows of the vector table for the tokens of a text, in parts of bounded size."""
    found = TOKEN.findall(text)
    for i in range(0, len(found), PART):
        yield np.fromiter(map(zlib.crc32, found[i : i + PART]), np.uint32) & np.uint32(SLOTS - 1)


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of every slot's sparse random index vector."""
    r = np.random.default_rng(seed)
    return r.integers(0, DIM, (SLOTS, NONZERO)), r.choice([-1.0, 1.0], (SLOTS, NONZERO))


def add_contexts(table: np.ndarray, ids: np.ndarray, ends: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Add to each token's row the index vectors of the tokens up to WINDOW places away in the same text."""
    for gap in range(1, WINDOW + 1):
        a, b = ids[:-gap], ids[gap:]
        same = ends[:-gap] == ends[gap:]
        a, b = a[same], b[same]
        for to, of in ((a, b), (b, a)):
            for k in range(NONZERO):
                table += np.bincount(to.astype(np.int64) * DIM + place[of, k], weights=sign[of, k], minlength=SLOTS * DIM)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors of all texts: a SLOTS x DIM table with rows of length 1 (zero if never met).

    Every task adds up whole numbers for the texts it reads and gives one row per slot; one shuffle sums them,
    so the result doesn't depend on order. What comes to the driver is the table of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        table, ids, ends, held = np.zeros(SLOTS * DIM), [], [], 0

        def flush():
            nonlocal ids, ends, held
            if ids:
                add_contexts(table, np.concatenate(ids), np.concatenate(ends), place, sign)
            ids, ends, held = [], [], 0

        doc = 0
        for batch in batches:
            for body in utf8(batch.column(0)):
                doc += 1
                for part in slots(body or b""):
                    ids.append(part)
                    ends.append(np.full(len(part), doc))
                    held += len(part)
                    if held > 1 << 20:
                        flush()
        flush()
        rows = table.reshape(SLOTS, DIM)
        used = np.flatnonzero(rows.any(1))
        flat = pa.array(rows[used].ravel(), pa.int64(), safe=False)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(np.arange(0, (len(used) + 1) * DIM, DIM, dtype=np.int32), flat)], names=["slot", "v"])

    parts = docs.select(F.col(text)).mapInArrow(run, "slot int, v array<long>")
    sums = parts.groupBy("slot").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIM)])
    sums = fetch(sums)
    out = np.zeros((SLOTS, DIM), np.float32)
    raw = sums.drop(columns="slot").to_numpy(float)
    out[sums["slot"].to_numpy()] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return out


def pooled(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """Pool a text's word vectors to SIZE numbers.

    The mean and spread of each dimension, the mean's length, how alike neighbours' vectors are (mean and spread of their
    products, share of equal ones), the share of distinct ones, and the log of the length.
    """
    n, total, squares, near, used = 0, np.zeros(DIM), np.zeros(DIM), np.zeros(3), np.zeros(SLOTS, bool)
    for ids in slots(text or b""):
        rows = vectors[ids]
        n += len(ids)
        total += rows.sum(0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", rows, rows, dtype=np.float64)
        alike = np.einsum("ij,ij->i", rows[1:], rows[:-1], dtype=np.float64)
        near += alike.sum(), alike @ alike, (ids[1:] == ids[:-1]).sum()
        used[ids] = True
    mean = total / max(n, 1)
    spread = np.sqrt(np.maximum(squares / max(n, 1) - mean * mean, 0))
    near /= max(n - 1, 1)
    near[1] = np.sqrt(max(near[1] - near[0] * near[0], 0))
    return np.concatenate([mean, spread, [np.linalg.norm(mean)], near, [used.sum() / max(n, 1), np.log1p(n)]])


class Network:
    """Two layers on standardised pooled vectors; ``temperature`` divides the logit."""

    def __init__(self, size: int, hidden: int = 24, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0
        self.w = [r.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> Network:
        """Adam on cross-entropy over four fifths of the rows; the temperature is chosen on the last fifth.

        With one class only, the network answers that class's smoothed share.
        """
        if not len(y) or y.min() == y.max():
            self.w = [w * 0 for w in self.w]
            self.w[3] = np.log([(y.sum() + 1) / (len(y) - y.sum() + 1)])
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        z, t = (x - self.mean) / self.scale, y.astype(float)
        m, v, step = [w * 0 for w in self.w], [w * 0 for w in self.w], 0
        for epoch in range(epochs):
            r.shuffle(train)
            for i in range(0, len(train), 128):
                rows = train[i : i + 128]
                a, b, c, d = self.w
                h = np.tanh(z[rows] @ a + b)
                e = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - t[rows]) / len(rows)
                back = np.outer(e, c) * (1 - h * h)
                grads = [z[rows].T @ back + decay * a, back.sum(0), h.T @ e + decay * c, np.array([e.sum()])]
                step += 1
                lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - lr * m[k] / (np.sqrt(v[k]) + 1e-8)
        if len(held):
            logits = self.logits(x[held])

            def loss(temperature: float) -> float:
                return np.logaddexp(0, np.where(t[held] > 0, -1, 1) * logits / temperature).mean()

            self.temperature = float(min(np.geomspace(0.3, 5, 60), key=loss))
        return self


class Model:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return self.network.probability(np.array([pooled(x, self.vectors) for x in texts]).reshape(len(texts), SIZE))


def labelled_sample(labels: DataFrame, label: str, most: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of (doc_id, label), by hash of doc_id; ids with a null or contradicting label are left out.

    Only about a quarter more rows than wanted, by their hash, are ordered, so what tasks send doesn't grow with the table.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("top"))
    one = materialize(one.filter("label = top").select("doc_id", "label"))
    share = min(1.0, (1.25 * most + 100) / max(one.count(), 1))
    near = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    return near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most: int = MOST_LABELLED) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``most`` rows of ``labels`` (doc_id, label)."""
    vectors = word_vectors(docs, text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)
    sample = F.broadcast(materialize(labelled_sample(labels, label, most)))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(sample, "doc_id")
    pools = map_text(rows, lambda: lambda texts: {"x": [pooled(t, shared.value).tolist() for t in texts]}, "x array<double>", ["doc_id", "label"])
    got = fetch(pools).sort_values(["doc_id"], kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), SIZE)
    order = np.lexsort((*x.T[:4], got["doc_id"].to_numpy()))  # repeated ids: an order that doesn't depend on tasks
    return Model(vectors, Network(SIZE).fit(x[order], got["label"].to_numpy()[order]))


def classify(docs: DataFrame, model: Model, carry: list[str], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Append ``score`` (calibrated probability of good quality) and ``predicted`` to every row.

    Null and empty texts pool to zeros and get the network's answer for them. Whole texts are pooled in parts, so very
    long ones need no more memory. Ties at the threshold count as 1. Input columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes | None]) -> dict[str, list]:
        score = shared.value.score(texts)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_text(docs, lambda: work, "score double, predicted int", carry, text)
