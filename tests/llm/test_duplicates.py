"""Operators 3 and 5 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lexspan.llm import embeddings, simhash
from lexspan.llm.common import components, union_min


def slow_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " ", "One", "one TWO", "A b c a b c a b c", "ÄÖ ü\x0bß x\x1fy z", "a " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_long_text_in_parts():
    text = " ".join(f"w{k % 999}" for k in range(40_000))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def near(r, n, base):
    keys = set()
    while len(keys) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        keys.add(x)
    return np.unique(np.array(sorted(keys), np.uint64))


@pytest.mark.parametrize("n,base", [(1, 1), (2, 1), (60, 20), (700, 5), (700, 700)])
@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_finds_all_pairs(n, base, budget):
    r = random.Random(n * base + budget)
    k = near(r, n, [r.getrandbits(64) for _ in range(base)])
    i, j = simhash.trie_pairs(k, budget)
    d = np.bitwise_count(k[:, None] ^ k[None, :])
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(d <= budget))) if a < b}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def test_many_tries_at_once():
    r = random.Random(3)
    parts = [near(r, n, [r.getrandbits(64) for _ in range(3)]) for n in (1, 40, 2, 300)]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    i, j = simhash.trie_pairs(np.concatenate(parts), 3, starts)
    want = sum(((np.bitwise_count(k[:, None] ^ k[None, :]) <= 3).sum() - len(k)) // 2 for k in parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    assert len(i) == want and (owner[i] == owner[j]).all()


@pytest.mark.parametrize("most", [3, 2000])  # 3: every bucket is dealt again and shared out in salts
def test_links_keep_every_component(spark, most):
    r = random.Random(11)
    k = near(r, 400, [r.getrandbits(64) for _ in range(40)])
    points = spark.createDataFrame([(int(x),) for x in k.view(np.int64)], "fp long")
    roots = {x["node"]: x["root"] for x in components(simhash.links(points, 3, most)).collect()}
    d = np.bitwise_count(k[:, None] ^ k[None, :]) <= 3
    want = union_min(len(k), *np.nonzero(d))
    got = [roots.get(int(x), int(x)) for x in k.view(np.int64)]
    groups = lambda v: sorted(sorted(np.flatnonzero(np.array(v) == g).tolist()) for g in set(v))
    assert groups(got) == groups(want.tolist())


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (50, 51), (51, 50), (51, 52)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 1 for k in range(1, 40)) and got[52] == 50 and len(got) == 61 + 39 + 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, odd, empty):
    base = [" ".join(random.Random(k).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=400)) for k in range(6)]
    rows = [(k, base[k % 6] + (" tail" if k > 11 else "")) for k in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs, words=3).collect()}
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    root = union_min(len(rows), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    assert [out[k]["component_id"] for k in range(18)] == root.tolist()
    assert [out[k]["fingerprint"] for k in range(18)] == [f"{int(x):016x}" for x in fps]
    assert all(out[k]["kept"] == (out[k]["component_id"] == k) for k in out)
    got = simhash.near_duplicates(odd, words=3).collect()
    assert len(got) == 12
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}  # null, empty, blank, and the null id's null text
    assert simhash.near_duplicates(empty).count() == 0


def vectors(seed=5, n=300, d=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for k in range(n // 2, n):
        x[k] = x[k - n // 2] + r.normal(size=d) * 0.14 * (k % 5) / 4
    return x.astype(np.float32)


def slow_links(x, labels, threshold):
    x = x.astype(float)
    cos = x @ x.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    hit = (cos >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("most", [4, 1500])
def test_vectors_against_brute_force(spark, monkeypatch, most):
    x, labels = vectors(), np.arange(300) % 150 % 3
    rows = [(k, [float(v) for v in x[k]], int(labels[k])) for k in range(300)]
    rows += [(300 + k, rows[0][1], rows[0][2]) for k in range(5)]  # copies of one vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    y, ylab = np.concatenate([x, np.repeat(x[:1], 5, 0)]), np.append(labels, [labels[0]] * 5)
    hit = slow_links(y, ylab, 0.98)
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(table, 0.98, most=most).collect()}
    got, want = sum(r["n_links"] for r in out.values()), int(hit.sum())
    assert want > 100 and 0.9 * want <= got <= want
    assert all(out[k]["n_links"] <= hit[k].sum() for k in out)
    assert out[0]["n_links"] >= 5 and all(out[300 + k]["component_id"] == 0 and not out[300 + k]["kept"] for k in range(5))
    if got == want:
        root = union_min(len(y), *np.nonzero(hit))
        assert [out[k]["component_id"] for k in range(len(y))] == root.tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    e = [1.0, 0.0, 2.0]
    rows = [(1, e, 1), (2, e, 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 1.0], 1), (8, [inf, 1.0, 1.0], 1), (9, [1.0, None, 1.0], 1), (10, [1.0, 2.0], 1), (11, [], 1), (None, e, 1), (2, e, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = embeddings.near_duplicates(table).collect()
    assert len(got) == 13
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert by[1]["n_links"] == 3 and by[1]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert all(by[k]["n_links"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in range(3, 12))
    assert next(r for r in got if r["vec_id"] is None)["n_links"] == 3
    none = table.limit(0)
    assert embeddings.near_duplicates(none).count() == 0
    assert embeddings.near_duplicates(table.filter("label is null")).count() == 1


def test_quantiser_is_balanced():
    x = embeddings.unit(vectors(n=2000).astype(float))
    bits = embeddings.Quantiser(x, 144).codes(x)
    assert bits.shape == (2000, 144) and (np.abs(bits.mean(0) - 0.5) < 0.2).all()


def test_links_of_every_length_of_vectors(spark):
    """Equal and near vectors of a length that few rows have link like others; different lengths don't."""
    x, short = vectors(n=40), [[1.0, 2.0], [1.0, 2.0], [1.0, 2.01], [-1.0, 2.0]]
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(40)] + [(100 + k, v, 1) for k, v in enumerate(short)]
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [out[100 + k]["n_links"] for k in range(4)] == [2, 2, 2, 0] and [out[100 + k]["component_id"] for k in range(4)] == [100, 100, 100, 103]
    assert [out[k]["n_links"] for k in range(40)] == slow_links(x, np.ones(40), 0.98).sum(1).tolist()


def test_substrings_widen_with_the_table_and_keep_recall():
    """Recall of codes alone, at a table's size now and at ten thousand times that."""
    r = np.random.default_rng(8)
    x = embeddings.unit(r.normal(size=(4000, 64)))
    y = embeddings.unit(x + r.normal(size=x.shape) * 0.19 / 8)  # cosine about 0.98
    near = (x * y).sum(1) >= 0.98
    assert near.sum() > 1000
    for most in (1000, 10_000_000):
        width, tables, radius = embeddings.layout(most, 0.98)
        q = embeddings.Quantiser(x, width * tables)
        a, b = q.codes(x), q.codes(y)
        meet = (a == b).reshape(-1, tables, width).all(2).any(1) & ((a != b).sum(1) <= radius)
        assert meet[near].mean() > 0.99, (width, tables, radius)
        chance = (a[:2000] == b[2000:]).reshape(-1, tables, width).all(2).mean()
        assert chance < 4 / 2**width


def jaccard(a, b, n=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [5, 2000])
def test_similar_documents(spark, odd, empty, most):
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(900)]
    rows, base = [], [r.choices(vocabulary, k=200) for _ in range(12)]
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(k % 5 * 2):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(r.choices(vocabulary, k=150))) for k in range(20)]
    out = {x["doc_id"]: x for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    near = np.array([[jaccard(a, b) for _, b in rows] for _, a in rows])
    ids = [k for k, _ in rows]
    for k, root in enumerate(union_min(len(rows), *np.nonzero(near >= 0.8))):
        assert out[ids[k]]["component_id"] == ids[root]
    assert all(x["kept"] == (x["component_id"] == x["doc_id"]) for x in out.values())
    got = simhash.similar_documents(odd).collect()
    assert len(got) == 12 and simhash.similar_documents(empty).count() == 0
    assert {x["component_id"] for x in got if x["doc_id"] in (1, 2, 3)} == {1}


def test_min_hashes_are_independent():
    """The standard error of the agreement of two sketches is that of independent min-hashes, and it is not biased."""
    r = np.random.default_rng(2)
    got = []
    for _ in range(600):
        all_ = np.unique(r.integers(0, 1 << 64, 500, np.uint64))
        a, b = all_[:450], all_[50:]
        assert simhash.jaccard(a, b) == pytest.approx(0.8, abs=0.01)
        x, y = (np.frombuffer(simhash.sketch(s)[2], np.uint8) for s in (a, b))
        got.append((x == y).mean())
    assert np.mean(got) == pytest.approx(0.8, abs=0.01) and np.std(got) < 0.06


def test_a_large_run_of_equal_fingerprints(monkeypatch):
    """Pairs of a run are looked at in parts; links are exact, and a pair below the similarity stays apart."""
    monkeypatch.setattr(simhash, "BATCH", 1000)
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 1 << 64, 100, np.uint64)) for _ in range(3)]
    sets = [np.unique(np.r_[base[k % 3][: 100 - k % 7], r.integers(0, 1 << 64, k % 4, np.uint64)]) for k in range(240)]
    n = len(sets)
    sk = np.zeros((n, simhash.SKETCH), np.uint8)
    task, fp = np.array([1] * 200 + [2] * 40), np.zeros(n, np.int64)
    root = simhash.similar_pairs(task, fp, sk, 24, 0.5, sets)
    near = np.array([[task[a] == task[b] and simhash.jaccard(sets[a], sets[b]) >= 0.8 for b in range(n)] for a in range(n)])
    assert (root == union_min(n, *np.nonzero(near))).all()


def test_shingles_of_short_and_long_texts():
    assert len(simhash.shingles(None)) == len(simhash.shingles(b" \n")) == 0 and len(simhash.shingles(b"a b")) == 1
    long = " ".join(f"w{k % 50_000}" for k in range(100_000)).encode()
    assert len(simhash.shingles(long)) == 50_000 and (np.diff(simhash.shingles(long).astype(object)) > 0).all()
