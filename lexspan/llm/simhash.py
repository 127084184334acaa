"""Near-duplicates by SimHash and a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, map_text, materialize, union_min

BITS, BLOCKS = 64, 4
#: Rows that a task joins at a time.
PART = 1 << 16


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of a text with A-Z lower-cased.

    A text with fewer words gives one shingle of all its words; a text without a word (null, empty, blank)
    gives zero. Ties (a bit set in exactly half the hashes) give 0. Long texts are hashed in parts.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    hashed, total, count = partial(xxhash.xxh64_intdigest, seed=seed), np.zeros(BITS, np.int64), max(1, len(tokens) - words + 1)
    for i in range(0, count, 1 << 15):
        part = tokens[i : min(i + (1 << 15), count) + words - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(words)])) if len(tokens) >= words else [b" ".join(tokens)]
        values = np.fromiter(map(hashed, shingles), np.uint64)
        total += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """Append ``fp`` (long: the 64 bits as a signed number) to every row."""

    def start():
        return lambda texts: {"fp": np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)}

    return map_text(docs, start, "fp long", carry, text)


#: A pair of trie nodes with this many key pairs or fewer is finished by popcounts.
LEAF = 64


def trie_pairs(keys: np.ndarray, budget: int, starts: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of distinct keys that differ in at most ``budget`` of ``bits`` bits.

    Sorted keys are a binary trie: a node is a range that shares its first bits. Pairs of nodes go down together from
    (root, root), one bit a level; a pair's differing bits add up and the pair is dropped once they exceed the
    budget. A pair of small nodes is a leaf and is finished by popcounts. ``starts`` are the first places of several tries that lie
    one after another in ``keys``; keys are paired within their own trie, and all tries go down at the same time.
    """
    n = len(keys)
    starts = np.zeros(min(n, 1), int) if starts is None else starts
    ends = np.append(starts[1:], n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    wide = ends - starts > 1
    todo = [(starts[wide], ends[wide], starts[wide], ends[wide], np.zeros(wide.sum(), int), 0)]
    while todo:
        lo1, hi1, lo2, hi2, cost, depth = todo.pop()
        if not len(lo1):
            continue
        if len(lo1) > 1 << 17:  # in parts: memory stays bounded
            half = len(lo1) // 2
            todo += [(*(x[part] for x in (lo1, hi1, lo2, hi2, cost)), depth) for part in (slice(None, half), slice(half, None))]
            continue
        n1, n2 = hi1 - lo1, hi2 - lo2
        leaf = (n1 * n2 <= LEAF) | (depth == bits)
        if leaf.any():
            count = (n1 * n2)[leaf]
            of = np.repeat(np.flatnonzero(leaf), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            i, j = lo1[of] + k // n2[of], lo2[of] + k % n2[of]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            found.append((i[near], j[near]))
            lo1, hi1, lo2, hi2, cost = (x[~leaf] for x in (lo1, hi1, lo2, hi2, cost))
            if not len(lo1):
                continue
        bit = np.uint64(bits - 1 - depth)
        mid1, mid2 = split(keys, lo1, hi1, bit), split(keys, lo2, hi2, bit)
        same = lo1 == lo2
        parts = []
        for a, (l1, h1) in enumerate(((lo1, mid1), (mid1, hi1))):
            for b, (l2, h2) in enumerate(((lo2, mid2), (mid2, hi2))):
                new = cost + (a != b)
                go = (h1 > l1) & (h2 > l2) & (new <= budget) & (~same | (a <= b))  # a node with itself: each pair of its children once
                parts.append((l1[go], h1[go], l2[go], h2[go], new[go]))
        todo.append((*(np.concatenate(x) for x in zip(*parts)), depth + 1))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*found))


def split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each range of sorted keys the given bit turns to 1; the bits above are equal in a range."""
    start = keys[lo]
    border = ((start >> bit) | np.uint64(1)) << bit
    low, high = lo.copy(), hi.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        left = open_ & (keys[np.minimum(mid, len(keys) - 1)] < border)
        low = np.where(left, mid + 1, low)
        high = np.where(open_ & ~left, mid, high)
    return low


def deal(points: DataFrame, value: str, width: int, *prefix: str) -> DataFrame:
    """Rows of (fp, bucket): for every block of ``width`` bits of ``value``, the bits there after the prefix.

    Two values within BLOCKS - 1 bits agree in a whole block at least, so they meet in a bucket.
    """
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftrightunsigned({value}, {k * width}) & {(1 << width) - 1}").alias("v")) for k in range(BLOCKS)])
    return points.select("fp", *prefix, F.explode(blocks).alias("x")).select("fp", F.concat_ws(".", *prefix, F.col("x.k"), F.col("x.v")).alias("bucket"))


def salted(buckets: DataFrame, most: int) -> DataFrame:
    """Rows of (fp, bucket, i, j): the shares of a bucket of n rows, in tasks of about 2 * most rows.

    A bucket within ``most`` rows is the one task (0, 0). A larger one is cut into s = ceil(n / most) shares by
    hash, and every pair of shares i <= j is a task, so no pair of rows is lost.
    """
    shares = F.ceil(F.col("n") / most).cast("int")
    own = buckets.withColumn("s", shares).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    return own.select("fp", "bucket", F.explode(tasks).alias("t")).select("fp", "bucket", "t.i", "t.j")


def links(points: DataFrame, budget: int = 3, most: int = 2000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``; their components are those of all pairs within budget.

    Fingerprints are dealt by four blocks of 16 bits (budget 3: a pair agrees in one block at least). A bucket
    of over ``most`` fingerprints is dealt again by four blocks of the other 48 bits, exact for the same reason;
    what is still larger (a dense group of near copies) is shared out as pairs of salts. In each task a trie is
    joined with itself; of the pairs it finds only a spanning forest leaves the task, so a dense group
    doesn't give the square of its size in rows.
    """
    if budget >= BLOCKS:
        raise ValueError(f"budget must be below {BLOCKS}")

    def counted(buckets: DataFrame) -> DataFrame:  # most buckets hold a single fingerprint: those never go to Python
        return buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket")

    first = materialize(counted(deal(points, "fp", 16)))
    shift = (F.split("bucket", r"\.")[0].cast("int") * 16 + 16) % 64
    turned = first.filter(F.col("n") > most).withColumn("r", shift).withColumn("turned", F.expr("if(r = 0, fp, shiftrightunsigned(fp, r) | shiftleft(fp, 64 - r))"))
    again = counted(deal(turned, "turned", 12, "bucket"))
    tasks = salted(first.filter(F.col("n") <= most).select("fp", "bucket", "n").unionByName(again.select("fp", "bucket", "n")), most)

    def forest(keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        i, j = trie_pairs(keys, budget, starts)
        root = union_min(len(keys), i, j)
        child = np.flatnonzero(root != np.arange(len(keys)))
        signed = keys.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task and fingerprint; tasks are joined many at a time, whole ones only."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            task, fp = (np.concatenate(x) for x in zip(*held))
            first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            upto = len(task) if last else first[-1]
            held[:] = [] if last else [(task[upto:], fp[upto:])]
            if upto:
                yield forest(fp[:upto].view(np.uint64), first[first < upto])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(t) for t, _ in held) > PART:
                yield from flush(False)
        if held:
            yield from flush(True)

    # one 64-bit number for a task; two tasks with the same number would only be joined together
    keyed = tasks.select(F.xxhash64("bucket", "i", "j").alias("task"), "fp").repartition("task")
    # unsigned order of fingerprints within a task
    return keyed.sortWithinPartitions("task", F.expr("fp ^ (-9223372036854775807 - 1)")).mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, budget: int = 3) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, kept).

    ``fingerprint`` is 16 lowercase hex digits. Documents link when their fingerprints differ in at most
    ``budget`` bits; ``component_id`` is the smallest doc_id reachable. Equal fingerprints are one node, so
    exact copies cost one row each however many they are. Null, empty and blank texts have fingerprint zero
    and link like others. Rows with a null doc_id get a fingerprint and the component of the other rows, if any,
    but can't name a component. Repeated doc_ids stay as rows. ``kept`` marks one row of each component
    if doc_ids are unique. An empty table gives an empty result; extra columns are not read.
    """
    prints = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", words))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = points.filter("rep is not null")
    roots = materialize(components(links(named.select("fp"), budget)).withColumnRenamed("node", "fp"))
    of = named.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    of = materialize(of)
    least = materialize(of.groupBy("root").agg(F.min("rep").alias("component_id")))
    final = materialize(of.join(least, "root").select("fp", "component_id"))
    discard(points, roots, of, least)
    out = prints.join(final, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: Min-hashes of a sketch (a byte of each is kept), and bands of so many of them that make bucket keys.
SKETCH, BANDS, BAND = 64, 12, 3
SEEDS, ODD = np.random.default_rng(11).integers(0, 1 << 64, (2, SKETCH), np.uint64) | np.array([[0], [1]], np.uint64)
#: Pairs of documents compared at a time, and bytes of shingle hashes that a task holds for a share of a group.
BATCH, SHARE = 1 << 16, 1 << 24


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of a text's word shingles, A-Z lower-cased; of a text with fewer words one, of a blank or null one none."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed, count, parts = partial(xxhash.xxh64_intdigest, seed=seed), max(1, len(tokens) - words + 1), []
    for i in range(0, count, 1 << 15):
        part = tokens[i : min(i + (1 << 15), count) + words - 1]
        found = map(b" ".join, zip(*[part[k:] for k in range(words)])) if len(tokens) >= words else [b" ".join(tokens)]
        parts.append(np.unique(np.fromiter(map(hashed, found), np.uint64)))
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def sketch(found: np.ndarray) -> tuple[int, list[int], bytes]:
    """(fingerprint, band keys, SKETCH bytes) of a set of shingle hashes; an empty set has zeros.

    Min-hash k orders hashes by (hash ^ seed[k]) * odd[k], with random seeds and odd factors.
    """
    if not len(found):
        return 0, [0] * BANDS, bytes(SKETCH)
    least, total = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64), np.zeros(BITS, np.int64)
    for i in range(0, len(found), 1024):
        part = found[i : i + 1024]
        least = np.minimum(least, ((part[:, None] ^ SEEDS) * ODD).min(0))
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    mixed = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    keys = [xxhash.xxh64_intdigest(mixed[k * BAND : (k + 1) * BAND].tobytes(), k) for k in range(BANDS)]
    return int(np.packbits(2 * total > len(found), bitorder="little").view(np.uint64)[0]), np.array(keys, np.uint64).view(np.int64).tolist(), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets, neither empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def similar_pairs(task: np.ndarray, fp: np.ndarray, sk: np.ndarray, budget: int, need: float, sets: list[np.ndarray] | None = None, similarity: float = 0.8) -> np.ndarray:
    """The root of every row in the forest that links rows of the same task; rows come sorted by task and fingerprint (unsigned).

    The trie of a task's distinct fingerprints is joined with itself; a run of equal ones stands for its members. Pairs within ``budget`` whose sketches agree in a
    share of ``need`` link; with ``sets`` only if their sets share ``similarity``, which is counted exactly, unless they are connected already.
    Pairs are expanded BATCH at a time.
    """
    first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    runs = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (task[1:] != task[:-1])])
    i, j = trie_pairs(fp[runs].view(np.uint64), budget, np.searchsorted(runs, first))
    size = np.diff(np.r_[runs, len(fp)])
    inner = np.flatnonzero(size > 1)
    i, j = np.r_[i, inner], np.r_[j, inner]
    upto = np.cumsum(size[i] * size[j])
    root = np.arange(len(fp))
    lengths = np.array([len(s) for s in sets]) if sets is not None else None
    for at in range(0, int(upto[-1]) if len(upto) else 0, BATCH):
        flat = np.arange(at, min(at + BATCH, int(upto[-1])))
        of = np.searchsorted(upto, flat, "right")
        k = flat - (upto[of] - size[i[of]] * size[j[of]])
        x, y = runs[i[of]] + k // size[j[of]], runs[j[of]] + k % size[j[of]]
        x, y = x[go := (x != y) & (root[x] != root[y])], y[go]
        near = (sk[x] == sk[y]).mean(1) >= need
        x, y = x[near], y[near]
        if sets is None:
            root = union_min(len(fp), np.r_[np.arange(len(fp)), x], np.r_[root, y])
            continue
        small, large = np.minimum(lengths[x], lengths[y]), np.maximum(lengths[x], lengths[y])
        x, y = x[fits := small >= similarity * large - 1e-9], y[fits]
        while len(x):  # one pair of every two components at a time: what they connect needs no further look
            _, pick = np.unique(np.minimum(root[x], root[y]) * len(fp) + np.maximum(root[x], root[y]), return_index=True)
            ok = [p for p in pick.tolist() if jaccard(sets[x[p]], sets[y[p]]) >= similarity - 1e-9]
            left = np.ones(len(x), bool)
            left[pick] = False
            root = union_min(len(fp), np.r_[np.arange(len(fp)), x[ok]], np.r_[root, y[ok]])
            left &= root[x] != root[y]
            x, y = x[left], y[left]
    return root


def linked(tasks: DataFrame, budget: int, need: float, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) of a spanning forest of every task's links, from rows (task, fp, rep, sk) and, for exact links, (set)."""
    exact = "set" in tasks.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tasks are joined many at a time, whole ones only."""
        held: list[tuple] = []
        sets: list[np.ndarray] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            task, fp, rep, sk = (np.concatenate(x) for x in zip(*held))
            upto = len(task) if last else int(np.flatnonzero(np.r_[True, task[1:] != task[:-1]])[-1])
            held[:] = [] if last else [(task[upto:], fp[upto:], rep[upto:], sk[upto:])]
            if upto:
                root = similar_pairs(task[:upto], fp[:upto], sk[:upto], budget, need, sets[:upto] if exact else None, similarity)
                del sets[:upto]
                child = np.flatnonzero(root != np.arange(upto))
                yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]])], names=["a", "b"])

        weight = 0
        for batch in batches:
            sk = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), sk))
            if exact:
                sets += [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
            weight += batch.nbytes
            if weight > SHARE // 4:
                yield from flush(False)
                weight = 0
        if held:
            yield from flush(True)

    columns = ["task", "fp", "rep", "sk", *(["set"] if exact else [])]
    return tasks.select(columns).repartition("task").sortWithinPartitions("task", F.expr("fp ^ (-9223372036854775807 - 1)")).mapInArrow(join, "a long, b long")


def shared_out(rows: DataFrame, group: str, sizes: DataFrame, most: int) -> DataFrame:
    """Append ``task`` to rows: a group's number, or if it has more than ``most`` rows (or SHARE bytes) a row for every pair of shares that its own is in."""
    shares = F.ceil(F.greatest(F.col("n") / most, F.col("bytes") / SHARE)).cast("int")
    own = rows.join(sizes, group).withColumn("s", shares).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    return own.withColumn("t", F.explode(pairs)).withColumn("task", F.xxhash64(group, "t.i", "t.j"))


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8, budget: int = 24, most: int = 2000, row: str | None = None) -> DataFrame:
    """(doc_id, component_id, kept) by the similarity (shared part) of two texts' sets of word shingles, where a few differing bits are too strict.

    Texts that share ``similarity`` of their shingles differ in about 10 and up to about ``budget`` of the 64 bits, too many to deal fingerprints by equal blocks. So
    documents meet in buckets by bands of three min-hashes (at 0.8 one of twelve bands agrees in 99.98 % of pairs); in a bucket the fingerprints' trie is
    joined with itself within ``budget``, and what agrees in enough of 64 min-hashes (four standard errors below ``similarity``) makes a group of candidates.
    Groups get their texts' shingle sets, and pairs link if they share ``similarity`` of them, counted exactly. Equal sets are one node; buckets and groups over ``most`` nodes are shared
    out as pairs of salts; a task emits a spanning forest. Texts with less than ``words`` words have one shingle of all their words. Null, empty and blank texts are one group.
    The graph's nodes are rows, named by the long column ``row``, which must be unique and the same at every reading and is returned too; without it rows
    are numbered and written here. ``component_id`` is the smallest doc_id of a component (null if it has none); ``kept`` marks exactly one row of each, the first by
    doc_id (null ids last) and then by row. Repeated rows are equal texts; an empty table gives an empty result; extra columns are not read.
    """

    def start():
        def work(texts):
            found = [shingles(x, words) for x in texts]
            made = [sketch(x) for x in found]
            return {
                "fp": np.array([m[0] for m in made], np.uint64).view(np.int64), "bands": [m[1] for m in made], "sk": [m[2] for m in made],
                "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in found], "bytes": [8 * len(x) for x in found],
            }

        return work

    def whole():
        return lambda texts: {"set": [shingles(x, words).tobytes() for x in texts]}

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.col(row).alias("row")] if row else []))
    read = read if row else materialize(read.withColumn("row", F.monotonically_increasing_id()))
    prints = materialize(map_text(read, start, "fp long, bands array<long>, sk binary, digest binary, bytes long", ["doc_id", "row"]))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = materialize(prints.groupBy("digest").agg(F.min("row").alias("rep"), F.min(first).alias("first"), F.min(F.struct("fp", "sk", "bytes", "bands")).alias("x")).select("digest", "rep", "first", "x.*"))
    dealt = nodes.select("rep", "fp", "sk", F.explode(F.array_distinct("bands")).alias("bucket"))
    near = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bytes")).filter("n > 1"))
    need = similarity - 4 * float(np.sqrt(similarity * (1 - similarity) / SKETCH))
    groups = materialize(components(linked(shared_out(dealt, "bucket", near, most), budget, need)).withColumnRenamed("node", "rep").withColumnRenamed("root", "grp"))
    few = materialize(nodes.select("rep", "fp", "sk", "bytes").join(groups, "rep"))
    sets = materialize(map_text(read.select(F.col("row").alias("rep"), "text").join(few, "rep"), whole, "set binary", ["rep", "fp", "sk", "grp", "bytes"]))
    sizes = materialize(sets.groupBy("grp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    tasks = shared_out(sets.select("rep", "fp", "sk", "set", "grp"), "grp", sizes, most)
    roots = materialize(components(linked(tasks, budget, need, similarity)).withColumnRenamed("node", "rep"))
    of = materialize(nodes.join(roots, "rep", "left").select("digest", "first", F.coalesce("root", "rep").alias("root")))
    least = materialize(of.groupBy("root").agg(F.min("first").alias("least")))
    final = materialize(of.join(least, "root").select("digest", "least"))
    discard(nodes, near, groups, few, sets, sizes, roots, of, least, *([] if row else [read]))
    out = prints.select("doc_id", "row", "digest").join(final, "digest")
    return out.select("doc_id", *([F.col("row").alias(row)] if row else []), F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
