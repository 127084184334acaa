"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import components, discard, fetch, materialize, union_min

#: Most vectors that a rotation is fitted on, chosen by hash; classes that share a substring on average; probability that a pair at the threshold is missed.
MOST_FITTED, AVERAGE, MISSED = 20_000, 64, 0.001


def layout(most: int, threshold: float) -> tuple[int, int, int]:
    """(bits of a substring, number of substrings, Hamming radius) for ``most`` vectors of one label.

    A bit of two vectors at the threshold differs with probability angle / pi. Substrings widen with the logarithm of the table, so buckets keep their size, and there are as
    many as it takes for a pair at the threshold to agree in one of them but for a probability of MISSED; the radius is six standard deviations beyond such a pair's mean.
    """
    width = max(8, math.ceil(math.log2(max(most, 1) / AVERAGE)))
    p = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    clean = (1 - p) ** width
    tables = max(1, math.ceil(math.log(MISSED) / math.log1p(-clean))) if clean < 1 else 1
    bits = width * tables
    return width, tables, min(bits, math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p))))


class Quantiser:
    """ITQ (Gong and Lazebnik, CVPR 2011): principal directions, then a rotation that brings codes near the data.

    Codes longer than the vectors take further rotations, learned from other beginnings.
    """

    def __init__(self, x: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 1):
        d = x.shape[1]
        r = np.random.default_rng(seed)
        self.mean = x.mean(0) if len(x) else np.zeros(d)
        z = x - self.mean
        _, vectors = np.linalg.eigh(z.T @ z / max(len(z), 1))
        parts, left = [], bits
        while left > 0:
            n = min(left, 64)
            base = vectors[:, ::-1][:, : min(d, n)]
            if d < n:  # fewer dimensions than bits: further random directions
                base = np.concatenate([base, r.normal(size=(d, n - d)) / np.sqrt(d)], axis=1)
            turn, v = np.linalg.qr(r.normal(size=(n, n)))[0], z @ base
            for _ in range(rounds if len(x) else 0):
                u, _, w = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
                turn = u @ w
            parts.append(base @ turn)
            left -= n
        self.matrix = np.concatenate(parts, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bits of every unit vector."""
        return (x - self.mean) @ self.matrix > 0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matches(left: pd.DataFrame, right: pd.DataFrame | None, table: int, radius: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked vectors that first meet in this table.

    Codes within ``radius`` are reranked: their cosine in double precision over the original vectors must reach the threshold. ``right`` None means
    pairs i < j within ``left``. A pair whose codes agree in a lower table's substring belongs there.
    """

    def parts(frame: pd.DataFrame):
        x = np.array(frame["embedding"].tolist(), np.float64)
        return x, np.sqrt((x * x).sum(1)), np.array(frame["code"].tolist(), np.int64).view(np.uint64), np.array(frame["keys"].tolist(), np.int64)

    x, nx, cx, kx = parts(left)
    y, ny, cy, ky = (x, nx, cx, kx) if right is None else parts(right)
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for i in range(0, len(x), 256):
        far = np.zeros((len(x[i : i + 256]), len(y)), np.uint16)
        for w in range(cx.shape[1]):
            far += np.bitwise_count(cx[i : i + 256, None, w] ^ cy[None, :, w])
        a, b = np.nonzero(far <= radius)
        a += i
        if right is None:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 1 << 15):
            p, q = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
            near = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
            p, q = p[near], q[near]
            first = (kx[p, :table] != ky[q, :table]).all(1)
            found.append((p[first], q[first]))
    return tuple(np.concatenate(v) for v in zip(*found))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, most: int = 1500, fitted: int = MOST_FITTED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): (vec_id, n_links, component_id, kept).

    Vectors of one length with equal labels link if their cosine reaches ``threshold``. A null label, a null, zero or empty vector, and
    one with null or non-finite components link with nothing. Equal vectors are one class, so copies cost a row each and never pairs. A class's code comes from
    rotations learned, for each length, on about ``fitted`` classes; every class is put in as many tables as ``layout`` says, by label, length and one substring of its
    code. Classes that share a bucket and lie within the Hamming radius are compared by their original vectors, each pair in its first table only, so
    counts add up; a bucket over ``most`` classes is shared out as pairs of salts. Only link counts and a
    spanning forest leave a task. Pairs that differ in every substring are missed (recall is measured in the tests). There is one rotation for each length; lengths
    are those of models, so few.

    ``component_id`` is the smallest vec_id reachable, itself included; rows with a null vec_id count as links but
    name nothing, and have a null component of their own. Repeated vec_ids stay as rows. Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    ok = F.coalesce(F.col("label").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = rows.filter(ok).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()).withColumn("len", F.size("embedding"))
    classes = materialize(classes)
    tally = classes.groupBy("label", "len").agg(F.count("*").alias("n")).groupBy("len").agg(F.max("n").alias("top"), F.sum("n").alias("n")).collect()
    if not tally:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width, tables, radius = layout(max(r["top"] for r in tally), threshold)
    share = F.element_at(F.create_map(*[F.lit(x) for r in tally for x in (r["len"], min(1.0, fitted / r["n"]))]), F.col("len"))
    sample = fetch(classes.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < share * (1 << 30)).select("len", "embedding"))
    by_length = {r["len"]: Quantiser(unit(x) if len(x := np.array([*map(list, sample.loc[sample["len"] == r["len"], "embedding"])], np.float64).reshape(-1, r["len"])) else x, width * tables) for r in tally}
    quantisers = spark.sparkContext.broadcast(by_length)
    words = -(-width * tables // 64)

    def code(frames):
        for frame in frames:
            codes, keys = np.zeros((len(frame), words), np.int64), np.zeros((len(frame), tables), np.int64)
            for length in frame["len"].unique():
                here = np.flatnonzero(frame["len"].to_numpy() == length)
                bits = quantisers.value[int(length)].codes(unit(np.array(frame["embedding"].iloc[here].tolist(), np.float64)))
                packed = np.packbits(bits, axis=1, bitorder="little")
                codes[here] = np.pad(packed, ((0, 0), (0, 8 * words - packed.shape[1]))).view(np.int64)
                keys[here] = (bits.reshape(len(here), tables, width) * (1 << np.arange(width))).sum(2)
            yield frame.assign(code=list(codes), keys=list(keys))

    columns = ["label", "len", "embedding", "n", "cls"]
    coded = materialize(classes.select(columns).mapInPandas(code, classes.select(columns).schema.add("code", ArrayType(LongType())).add("keys", ArrayType(LongType()))))
    slim = coded.select("label", "len", "cls", F.posexplode("keys").alias("t", "v"))
    bucket = ["label", "len", "t", "v"]
    sizes = slim.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1").select(*bucket, F.ceil(F.col("size") / most).cast("int").alias("s"))
    shared = materialize(sizes)
    dealt = slim.join(shared, bucket).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("s")).cast("int"))
    shares = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    dealt = dealt.select(*bucket, "cls", "mine", F.explode(shares).alias("p")).select(*bucket, "cls", "mine", "p.i", "p.j")
    full = dealt.join(coded.select("cls", "embedding", "n", "code", "keys"), "cls")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        table, i, j = int(key[2]), key[4], key[5]
        group = group.sort_values("cls", kind="stable")
        if i == j:
            left = right = group
            x, y = matches(left, None, table, radius, threshold)
        else:
            left, right = group[group["mine"] == i], group[group["mine"] == j]
            if not len(left) or not len(right):
                return pd.DataFrame({"edge": [], "a": [], "b": []})
            x, y = matches(left, right, table, radius, threshold)
        cx, cy = left["cls"].to_numpy()[x], right["cls"].to_numpy()[y]
        counted = np.concatenate([cx, cy]), np.concatenate([right["n"].to_numpy()[y], left["n"].to_numpy()[x]])
        nodes, place = np.unique(counted[0], return_inverse=True)
        total = np.bincount(place, weights=counted[1], minlength=len(nodes)).astype(np.int64)
        root = union_min(len(nodes), place[: len(cx)], place[len(cx) :])
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"edge": np.r_[np.zeros(len(nodes), bool), np.ones(len(child), bool)], "a": np.r_[nodes, nodes[child]].astype(np.int64), "b": np.r_[total, nodes[root[child]]].astype(np.int64)})

    found = materialize(full.groupBy(*bucket, "i", "j").applyInPandas(compare, "edge boolean, a long, b long"))
    links = found.filter("not edge").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    roots = components(found.filter("edge").select("a", "b")).withColumnRenamed("node", "cls")
    of = classes.select("cls", "rep", "n", "label", "embedding").join(links, "cls", "left").join(roots, "cls", "left")
    of = materialize(of.select("label", "embedding", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    least = materialize(of.groupBy("root").agg(F.min("rep").alias("component_id")))
    of, roots_of = materialize(of.join(least, "root").select("label", "embedding", "n_links", "component_id")), of
    discard(classes, coded, shared, found, roots_of, least)
    good = rows.filter(ok).join(of, ["label", "embedding"]).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).cast("long").alias("component_id"))
    bad = rows.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
