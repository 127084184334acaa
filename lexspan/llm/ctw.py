"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetch, least_count, map_text, materialize, trim_memory, utf8

#: Bytes of context; most bytes-in-context whose probabilities, and most words whose counts, are broadcast (the most frequent ones: at most
#: 25 MB; all others come from the whole tables by joins, so neither bound changes a result); depth at which the tree is dealt to tasks.
DEPTH, MOST_GRAMS, MOST_WORDS, ROOT = 5, 400_000, 100_000, 2
END = b"\n"
U = np.uint64


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def stream(words: list[bytes]) -> bytes:
    """What the model codes: a text's words, lower-cased, with one space between, and one end byte."""
    return b" ".join(words) + END


def grams(parts: list[bytes], depth: int) -> np.ndarray:
    """For every byte of every stream, the ``depth`` bytes before it and itself as one number; before a stream lie end bytes."""
    pad = END * depth
    data = np.frombuffer(b"".join(pad + s for s in parts), np.uint8).astype(U)
    keys = np.zeros(len(data) - depth, U)
    for k in range(depth + 1):
        keys = (keys << U(8)) | data[k : len(data) - depth + k]
    real = np.ones(len(keys) + depth, bool)
    at = 0
    for s in parts:
        real[at : at + depth] = False
        at += depth + len(s)
    return keys[real[depth:]]


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def corpus_counts(docs: DataFrame, depth: int, text: str = "text", part: int = 1 << 20, most: int = 1_000_000) -> DataFrame:
    """(word, gram, n) over whole texts: a row has a word (binary; the end byte for ends) or a gram, and how often it occurs.

    A task adds up what it reads in bounded memory; one shuffle sums the tasks' counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held, size, done, rows = [], 0, [], 0

        def rows_of(w, g, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "n"])

        def emit_words():
            keys = list(words)
            yield rows_of(keys, [None] * len(keys), list(words.values()))
            words.clear()

        def emit_grams():
            keys, n = add_up(np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done]))
            for i in range(0, len(keys), 1 << 17):
                k = keys[i : i + (1 << 17)]
                yield rows_of(pa.nulls(len(k), pa.binary()), k.view(np.int64), n[i : i + (1 << 17)])
            done.clear()

        def count():
            nonlocal held, size, rows
            if held:
                keys, n = np.unique(grams(held, depth), return_counts=True)
                done.append((keys, n))
                rows += len(keys)
            held, size = [], 0

        for batch in batches:
            for body in utf8(batch.column(0)):
                found = tokens(body)
                words.update(found)
                words[END] += 1
                s = stream(found)
                held.append(s)
                size += len(s)
                if size > part:
                    count()
            if rows > most:
                done[:] = [add_up(np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done]))]
                rows = len(done[0][0])
                if rows > most // 2:
                    yield from emit_grams()
                    rows = 0
            if len(words) > 150_000:
                yield from emit_words()
        count()
        if words:
            yield from emit_words()
        if done:
            yield from emit_grams()
        trim_memory()

    return docs.select(F.col(text)).mapInArrow(run, "word binary, gram long, n long").repartition("word", "gram").groupBy("word", "gram").agg(F.sum("n").alias("n"))


class Table:
    """A fixed map from 64-bit keys to places, looked up in vectors: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), self.hash(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several keys for a slot the last one stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> U(31))) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.hash(keys)
        out = self.slot[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.slot[at].astype(np.int64)
            out[open_] = found
            on = (found >= 0) & (self.keys[found] != keys[open_])
            open_, at = open_[on], at[on]
        return out


def node_key(depth: int, context: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """One number for a binary node: depth, context bytes, and the bits of the coded byte so far after a leading 1."""
    return (U(depth) << U(60)) | (context << U(8)) | prefix


SMALL = 1 << 16
HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(SMALL - 1) + 0.5))])
WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(SMALL - 1) + 1.0))])


def log_gamma(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    """log(gamma(n + shift) / gamma(shift)): from a table, and for large n from Stirling's series."""
    out = table[np.minimum(n, SMALL - 1)]
    if (big := n >= SMALL).any():
        x = n[big] + shift
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - math.lgamma(shift)
    return out


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones in any one order."""
    return log_gamma(HALF, a, 0.5) + log_gamma(HALF, b, 0.5) - log_gamma(WHOLE, a + b, 1.0)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def above(key: np.ndarray, depth: int) -> np.ndarray:
    """The keys of the nodes one byte of context shorter, of nodes at ``depth``."""
    return node_key(depth - 1, ((key & U((1 << 60) - 1)) >> U(8)) & U((1 << (8 * (depth - 1))) - 1), key & U(255))


class Nodes:
    """Binary nodes (d context bytes, bits of the coded byte so far) of some depths, with the probability of a one in the node alone and
    the posterior weight of stopping there."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        key, self.one, self.stop = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U), np.zeros(0), np.zeros(0))
        self.table = Table(key)


def weighed(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of a one, weight of stopping, log of the weighted probability) of nodes that saw a zeros and b ones; ``below`` is what
    their children give for the same bits, None at the greatest depth."""
    own = kt_log(a, b)
    one = (b + 0.5) / (a + b + 1.0)
    if below is None:
        return one, np.ones(len(own)), own
    return one, 1 / (1 + np.exp(np.clip(below - own, -500, 500))), np.logaddexp(own, below) - math.log(2)


def grow(keys: np.ndarray, n: np.ndarray, depth: int, root: int = 0) -> tuple[Nodes, tuple[np.ndarray, ...]]:
    """The whole subtrees, from ``depth`` up to ``root``, over counts n of keys (``depth`` context bytes and the coded byte).

    Also returns (key, zeros, ones, log of the weighted probability) of the nodes at ``root``.
    """
    context, byte = keys >> U(8), keys & U(255)
    nodes = np.concatenate([node_key(depth, context, (U(1) << U(b)) | (byte >> U(8 - b))) for b in range(8)])
    ones = np.concatenate([(byte >> U(7 - b)) & U(1) for b in range(8)]).astype(np.int64)
    weight = np.tile(n, 8)
    key, a, b = summed(nodes, weight * (1 - ones), weight * ones)
    below, parts = None, []
    for d in range(depth, root - 1, -1):
        one, stop, log_w = weighed(a, b, below)
        parts.append((key, one, stop))
        if d > root:
            key, a, b, below = summed(above(key, d), a, b, log_w)
    return Nodes(parts), (key, a, b, log_w)


def mixture(keys: np.ndarray, depth: int, deep: Nodes, top: Nodes | None = None, root: int = 0) -> np.ndarray:
    """log10 probability of the last byte of every key after its context: all depths mixed, from the deepest up.

    Nodes above ``root`` are in ``top``. A context that wasn't seen knows nothing and gives one half.
    """
    total, byte, context = np.zeros(len(keys)), keys & U(255), keys >> U(8)
    for b in range(8):
        prefix, bit = (U(1) << U(b)) | (byte >> U(8 - b)), ((byte >> U(7 - b)) & U(1)).astype(bool)
        p = np.full(len(keys), 0.5)
        for d in range(depth, -1, -1):
            nodes = deep if d >= root else top
            at = nodes.table.find(node_key(d, context & U((1 << (8 * d)) - 1), prefix))
            if (hit := np.flatnonzero(at >= 0)).size:
                stop = nodes.stop[at[hit]]
                p[hit] = stop * nodes.one[at[hit]] + (1 - stop) * p[hit]
        total += np.log10(np.where(bit, p, 1 - p))
    return total


class Model:
    """What every task gets: the top of the tree, values of the most frequent bytes in context, counts of the most frequent words, the totals."""

    def __init__(self, depth: int, root: int, top: Nodes, n: int, v: int):
        self.depth, self.root, self.top, self.n, self.v = depth, root, top, n, v
        self.words: dict[bytes, int] = {}
        self.known, self.value = Table(np.zeros(0, U)), np.zeros(0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def by_subtree(grams: DataFrame, root: int, work, schema: str, most: int = 200_000) -> DataFrame:
    """``work`` (arrays gram, n -> record batches) over whole subtrees at ``root``, many small ones at a time.

    Rows are dealt by the last ``root`` context bytes. A subtree's rows are different grams, already summed, so its size is bounded by the alphabet
    and not by how often a context occurs.
    """
    dealt = grams.withColumn("sub", F.shiftright("gram", 8).bitwiseAND((1 << (8 * root)) - 1)).select("sub", "gram", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            sub, gram, n = (np.concatenate(x) for x in zip(*held))
            upto = len(sub) if last else int(np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])[-1])
            held[:] = [] if last else [(sub[upto:], gram[upto:], n[upto:])]
            if upto:
                yield from work(gram[:upto].view(U), n[:upto])

        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            rows += batch.num_rows
            if rows > most:
                yield from flush(False)
                rows = sum(len(h[0]) for h in held)
        if held:
            yield from flush(True)
        trim_memory()

    return dealt.repartition("sub").sortWithinPartitions("sub").mapInArrow(run, schema)


def tree_top(grams: DataFrame, depth: int, root: int) -> Nodes:
    """The nodes above ``root``, at most 255 for each context of ``root`` - 1 bytes: sums of what the subtrees give."""
    if not root:
        return Nodes([])

    def work(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, a, b, log_w = grow(gram, n, depth, root)[1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (above(key, root).view(np.int64), a, b, log_w)], names=["key", "a", "b", "w"])

    sums = by_subtree(grams, root, work, "key long, a long, b long, w double")
    # decimals add up alike in any order
    found = fetch(sums.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("w").cast("decimal(30,9)")).cast("double").alias("w")))
    key, a, b, below = summed(found["key"].to_numpy().astype(np.int64).view(U), *(found[c].to_numpy() for c in ("a", "b", "w")))
    parts = []
    for d in range(root - 1, -1, -1):
        one, stop, log_w = weighed(a, b, below)
        parts.append((key, one, stop))
        if d:
            key, a, b, below = summed(above(key, d), a, b, log_w)
    return Nodes(parts)


def values(grams: DataFrame, wanted: DataFrame, model: Model) -> DataFrame:
    """(gram, value): the log10 probability of every ``wanted`` gram's last byte by the whole tree, each in its subtree's task."""
    shared = grams.sparkSession.sparkContext.broadcast((model.depth, model.root, model.top))

    def work(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        depth, root, top = shared.value
        asked = n < 0
        if not asked.any():
            return
        subs = gram >> U(8) & U((1 << (8 * root)) - 1)
        held = ~asked & np.isin(subs, np.unique(subs[asked]))
        deep, want = grow(gram[held], n[held], depth, root)[0], gram[asked]
        for i in range(0, len(want), 1 << 16):
            part = want[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(mixture(part, depth, deep, top, root))], names=["gram", "value"])

    both = grams.select("gram", "n").unionByName(wanted.select("gram", F.lit(-1).cast("long").alias("n")))
    return by_subtree(both, model.root, work, "gram long, value double")


def fit(docs: DataFrame, text: str = "text", depth: int = DEPTH, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS) -> tuple[Model, DataFrame]:
    """A model of all texts of ``docs`` (null: empty) and the table (word, gram, n) of all words' and all bytes-in-context's counts.

    The tree holds every context of the corpus, so it grows with it: it stays a written table of its deepest counts, dealt to tasks by subtree. Only its
    top (at most 255 * 257 nodes) is collected. ``most_grams`` and ``most_words`` bound what is broadcast to spare joins in scoring.
    With an empty table the model gives every bit probability 1/2.
    """
    counts = materialize(corpus_counts(docs, depth, text))
    words, grams = counts.filter("word is not null").select("word", "n"), counts.filter("gram is not null").select("gram", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    root = min(ROOT, depth)
    model = Model(depth, root, tree_top(grams, depth, root), int(total[0]), int(total[1]))
    frequent = fetch(values(grams, grams.filter(F.col("n") >= least_count(grams, most_grams)), model))
    model.known, model.value = Table(frequent["gram"].to_numpy().astype(np.int64).view(U)), frequent["value"].to_numpy()
    top = fetch(words.filter(F.col("n") >= least_count(words, most_words)))
    model.words = dict(zip(top["word"], top["n"].tolist()))
    return model, counts


def per_text(owner: np.ndarray, texts: int, *columns: pa.Array, names: list[str]) -> pa.ListArray:
    """For every text the list of its rows; ``owner`` is sorted."""
    starts = np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(list(columns), names=names))


def score(docs: DataFrame, model: Model, counts: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """Append (n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) to every row.

    ``score`` is the log10 probability of the text's stream by the tree, ``base_score`` that of its tokens by smoothed word
    counts. Values of frequent bytes in context and counts of frequent words are broadcast; all others of a text, if any, come by joins with the whole
    tables, one row per text and different gram or word, so both scores are those of the whole model at any size. A null or empty text is the end
    token alone. Repeated rows are scored each. Input columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = 1 << 20

    def start():
        m = shared.value
        known = m.words

        def by_tree(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Sums of broadcast values; and (text, gram, times) of the grams that are to be joined."""
            keys = grams(streams, m.depth)
            at = m.known.find(keys)
            hit = at >= 0
            value = np.zeros(len(keys))
            value[hit] = m.value[at[hit]]
            sizes = np.array([len(s) for s in streams])
            sums = np.add.reduceat(value, np.cumsum(sizes) - sizes)
            far = np.flatnonzero(~hit)
            owner, key = np.repeat(np.arange(len(streams)), sizes)[far], keys[far]
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, int)
            return sums, owner[first], key[first].view(np.int64), np.diff(np.r_[first, len(key)])

        def work(texts: list[bytes | None]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "bytes")}
            held, size, done, made = [], 0, 0, []
            rare, times, of = [], [], []

            def flush() -> None:
                nonlocal held, size, done
                if held:
                    sums, owner, key, n = by_tree(held)
                    made.append((sums, owner + done, key, n))
                    done += len(held)
                held, size = [], 0

            for k, text in enumerate(texts):
                found = tokens(text)
                held.append(stream(found))
                out["bytes"].append(len(held[-1]))
                size += len(held[-1])
                if size > most:
                    flush()
                seen = Counter(found)
                seen[END] += 1
                c = np.fromiter((known.get(w, 0) for w in seen), np.int64, len(seen))
                n = np.fromiter(seen.values(), np.int64, len(seen))
                hit = c > 0
                out["n_tokens"].append(len(found) + 1)
                out["n_known"].append(int(n[hit].sum()))
                out["base"].append(float((n[hit] * m.base(c[hit])).sum()))
                if not hit.all():
                    lost = [w for w, h in zip(seen, hit.tolist()) if not h]
                    rare += lost
                    times.append(n[~hit])
                    of.append(np.full(len(lost), k))
            flush()
            sums, owner, key, n = (np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0), *[np.zeros(0, np.int64)] * 3)
            out["score"] = sums
            out["far"] = per_text(owner, len(texts), pa.array(key), pa.array(n.astype(np.int64)), names=["gram", "times"])
            times, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (times, of))
            out["rare"] = per_text(of, len(texts), pa.array(rare, pa.binary()), pa.array(times), names=["word", "times"])
            return out

        return work

    new = "n_tokens long, n_known long, base double, score double, bytes long, rare array<struct<word:binary,times:long>>, far array<struct<gram:long,times:long>>"
    names = {"n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"}
    made = map_text(docs, start, new, [c for c in carry if c not in names], text).withColumn("__row", F.monotonically_increasing_id())
    made = materialize(made)
    words, every = counts.filter("word is not null").select("word", "n"), counts.filter("gram is not null").select("gram", "n")
    far = made.select("__row", F.explode("far").alias("r")).select("__row", "r.gram", "r.times")
    value = materialize(values(every, far.select("gram").distinct(), model))
    by_gram = far.join(value, "gram").select("__row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("value")).alias("tree"))
    rare = made.select("__row", F.explode("rare").alias("r")).select("__row", "r.word", "r.times")
    base = lambda c: F.log10((c + F.lit(0.5)) / F.lit(model.n + 0.5 * (model.v + 1)))
    c = F.coalesce(F.col("n"), F.lit(0))
    by_word = rare.join(words, "word", "left").select("__row", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * base(c)).alias("base"), F.lit(0.0).alias("tree"))
    rest = by_gram.unionByName(by_word).groupBy("__row").agg(F.sum("known").alias("__known"), F.sum("base").alias("__base"), F.sum("tree").alias("__tree"))
    out = made.drop("rare", "far").join(rest, "__row", "left").withColumn("score", F.col("score") + F.coalesce("__tree", F.lit(0.0)))
    held = [c for c in made.columns if c not in ("n_tokens", "n_known", "base", "score", "bytes", "rare", "far", "__row")]
    return out.select(
        *[F.col(f"`{c}`") for c in held], "n_tokens", (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("__base", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
    )
