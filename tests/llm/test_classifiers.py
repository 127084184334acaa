"""Operators 1, 2 and 6: held-out accuracy on a small corpus, and odd rows."""

import zlib

import numpy as np
import pytest

from lexspan.llm import langid, quality, toxicity
from lexspan.llm.common import fold


def held(labels, m, k):
    return labels.filter(fold("doc_id", m) != k)


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(-3, 50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_quality_learns_and_holds_out(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, held(labels, 5, 0))
    out = quality.classify(docs, model, ["doc_id", "score"], threshold=0.3).join(labels, "doc_id").select("*", (fold("doc_id", 5) == 0).alias("h")).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and out.columns.tolist().count("score") == 1
    test = out[out["h"]]
    assert (test["predicted"] == test["quality"]).mean() > 0.9
    assert ((out["score"] >= 0.3).astype(int) == out["predicted"]).all()


def test_random_indexing_matches_brute_force(spark):
    texts = ["a b c a", "b c", None, "", "###"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = quality.word_vectors(docs)
    place, sign = quality.index_vectors()
    want = np.zeros((quality.SLOTS, quality.DIM))
    for t in texts:
        ids = [zlib.crc32(w) & (quality.SLOTS - 1) for w in quality.TOKEN.findall((t or "").encode())]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= quality.WINDOW:
                    np.add.at(want[a], place[b], sign[b])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(norm, 1e-9), atol=1e-6)


def test_pooling_in_parts_equals_whole(monkeypatch):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    text = " ".join(f"w{k % 300}" for k in range(1000)).encode()
    whole = quality.pooled(text, vectors)
    monkeypatch.setattr(quality, "PART", 1 << 14)
    assert np.allclose(whole, quality.pooled(text, vectors)) and np.isfinite(quality.pooled(None, vectors)).all()


def test_temperature_and_single_class():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    net = quality.Network(5).fit(x, (x[:, 0] + r.normal(size=400) > 0).astype(int))
    assert 0.3 <= net.temperature <= 5
    assert quality.Network(5).fit(x, np.ones(400)).probability(x).min() > 0.99
    assert quality.Network(5).fit(x[:0], np.zeros(0)).probability(x).tolist() == [0.5] * 400


def test_toxicity_learns_sparse_weights(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, held(labels, 3, 1))
    assert 0 < len(model.at) < 5000
    out = toxicity.classify(docs, model, ["doc_id"]).join(labels, "doc_id").toPandas()
    h = out[[zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]]
    order = np.argsort(h["score"].to_numpy())
    rank = np.empty(len(h))
    rank[order] = np.arange(len(h))
    y = h["toxic"].to_numpy()
    assert (rank[y == 1].mean() - rank[y == 0].mean()) / len(h) * 2 + 0.0 > 0.9  # nearly all toxic ones rank above
    assert out.loc[out["predicted"] == 1, "toxic"].mean() > 0.95


def test_toxicity_features_in_parts(monkeypatch):
    text = " ".join(f"w{k}" for k in range(500)).encode()
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PART", 64)
    assert (toxicity.features(text) == whole).all() and len(toxicity.features(None)) == 0
    assert (toxicity.features(b"You IDIOT") == toxicity.features(b"you, idiot!")).all()


def test_language_held_out(spark, corpus):
    docs, _ = corpus
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    out = langid.predict(docs, model, ["doc_id", "lang"]).toPandas()
    h = out[[zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]]
    assert (h["lang"] == h["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_language_counts_match_brute_force(spark, corpus):
    from collections import Counter

    docs, _ = corpus
    want = Counter((r["lang"], w) for r in docs.collect() for w in r["text"].lower().split())
    got = {(r["lang"], r["word"]): r["n"] for r in langid.word_counts(docs, flush=50).collect()}
    assert got == want


def test_backoff_takes_the_longest_known_gram():
    model = langid.Model(["x", "y"], {}, {"<ab": np.array([-1.0, -3.0]), "b": np.array([-5.0, -2.0])}, 5)
    assert model.unseen(["ab", "qq"]).tolist() == [[-3.0, -2.5], [0.0, 0.0]]  # <ab, then b alone; nothing known


def test_odd_rows(spark, corpus, odd, empty):
    docs, labels = corpus
    lang = langid.predict(odd, langid.fit(docs), ["doc_id", "text"]).collect()
    assert len(lang) == 12
    for r in lang:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    q, t = quality.fit(docs, labels), toxicity.fit(docs, labels)
    for out in (quality.classify(odd, q, ["doc_id"]), toxicity.classify(odd, t, ["doc_id"])):
        rows = out.collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    for out in (quality.classify(empty, q, ["doc_id"]), toxicity.classify(empty, t, ["doc_id"]), langid.predict(empty, langid.fit(empty), ["doc_id"])):
        assert out.count() == 0


def test_fit_on_nothing(spark, empty, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, quality.fit(empty, none), ["doc_id"]).count() == 12
    assert toxicity.classify(odd, toxicity.fit(empty, none), ["doc_id"]).count() == 12
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(empty), ["doc_id"]).collect()} == {"und"}


def test_labels_with_nulls_and_contradictions(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    assert sorted((r["doc_id"], r["label"]) for r in quality.labelled_sample(labels, "quality", 10).collect()) == [(1, 1), (4, 0)]


def slow_language(train, text, least_word, least_gram, add=0.5):
    """(language, score) by the definition: one word after the other, over whole words."""
    from collections import Counter

    words, grams = {}, {}
    for body, lang in train:
        for w in body.lower().split():
            words.setdefault(lang, Counter())[w] += 1
            m = f"<{w}>"
            grams.setdefault(lang, Counter()).update(m[a:b] for a in range(len(m)) for b in range(a + 1, min(a + 5, len(m)) + 1))
    langs = sorted(words)

    def table(counts, least):
        total = {x: sum(counts[x].values()) for x in langs}
        known = {u for x in langs for u, n in counts[x].items() if n >= total[x] * least}
        return {u: np.array([np.log10((counts[x][u] + add) / (total[x] + add * len(known))) for x in langs]) for u in known}

    words, grams = table(words, least_word), table(grams, least_gram)
    odds, found = np.zeros(len(langs)), text.lower().split()
    for w in found:
        if w in words:
            odds += words[w]
            continue
        m = f"<{w}>"
        units = [next((m[a:b] for b in range(min(a + 5, len(m)), a, -1) if m[a:b] in grams), None) for a in range(len(m))]
        units = [grams[u] for u in units if u]
        odds += sum(units) / len(units) if units else 0
    odds = odds / np.sqrt(len(found)) * np.log(10)
    odds = np.exp(odds - odds.max())
    return langs[int(odds.argmax())], odds.max() / odds.sum()


@pytest.mark.parametrize("least", [(1e-5, 1e-5), (0.004, 0.002)])
def test_predictions_match_brute_force(spark, corpus, least):
    docs = corpus[0].filter("doc_id < 60")
    train = [(r["text"], r["lang"]) for r in docs.collect()]
    model = langid.fit(docs, least_word=least[0], least_gram=least[1])
    texts = ["th er on", "schein unddie zzz", "x" * 300 + "schein", "qq", "e e e d"] + [t for t, _ in train[:10]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in langid.predict(rows, model, ["doc_id"]).collect():
        lang, score = slow_language(train, texts[r["doc_id"]], *least)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, rel=1e-6), texts[r["doc_id"]][:40]


def test_a_rare_language_and_texts_without_spaces(spark):
    """A hot language's many words don't crowd out a small one; an unbroken text is judged by all of it."""
    hot = [(k, " ".join(f"w{k}x{j}" for j in range(200)), "aa") for k in range(200)]
    docs = spark.createDataFrame([*hot, (500, "ñandu ñoño " * 3, "bb"), (501, "q" * 200 + "\u65e5\u672c" * 400, "cc")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = spark.createDataFrame([(1, "ñandu ñoño"), (2, "ñoñu"), (3, "q" * 100 + "\u65e5\u672c" * 900), (4, "w3x7 w9x9")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(texts, model, ["doc_id"]).collect()} == {1: "bb", 2: "bb", 3: "cc", 4: "aa"}


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    out = langid.predict(docs, langid.fit(docs), ["doc_id"]).collect()
    assert {(r["lang_pred"], round(r["score"], 6)) for r in out} == {("a", 0.5)}


def test_ftrl_matches_its_definition():
    """Plain dictionaries, one coordinate after the other, against the arrays."""
    import math

    r = np.random.default_rng(4)
    model, z, n, bias = toxicity.Ftrl(l1=0.5), {}, {}, 1 << toxicity.SPACE_BITS

    def weight(i):
        a, l1 = z.get(i, 0.0), 0.0 if i == bias else model.l1
        if i != bias and abs(a) <= l1:
            return 0.0
        return -(a - math.copysign(l1, a) * (a != 0)) / ((model.beta + math.sqrt(n.get(i, 0.0))) / model.alpha + model.l2)

    for k in range(60):
        x, y = r.choice(40, r.integers(0, 8), replace=False), float(r.integers(0, 2))
        model.learn(x, y)
        at = [*x.tolist(), bias]
        w = {i: weight(i) for i in at}
        g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (model.weight if y else 1)
        for i in at:
            before = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / model.alpha * w[i]
            n[i] = before + g * g
    every = model.weights(np.arange(41))
    assert np.allclose(every, [weight(i) for i in range(41)], rtol=1e-12) and (every == 0).any() and (every != 0).any()
    assert model.weights(np.array([bias]))[0] == pytest.approx(weight(bias))


def test_the_first_step_follows_the_numeric_gradient():
    """Adam's first step is the rate against the sign of the gradient, here taken by differences of the loss."""
    r = np.random.default_rng(6)
    x, y = r.normal(size=(10, 5)), np.array([0, 1] * 5)
    fitted, start = quality.Network(5, hidden=4), quality.Network(5, hidden=4)
    fitted.fit(x, y, epochs=1, rate=0.01)
    start.mean, start.scale = x.mean(0), x.std(0)
    order = np.random.default_rng(5).permutation(10)[2:]

    def loss():
        logits = start.logits(x[order])
        return np.logaddexp(0, np.where(y[order] > 0, -1, 1) * logits).mean() + 5e-5 * sum((w * w).sum() for w in (start.w[0], start.w[2]))

    for layer in range(4):
        for at in np.ndindex(start.w[layer].shape):
            held = start.w[layer][at]
            start.w[layer][at] = held + 1e-5
            up = loss()
            start.w[layer][at] = held - 1e-5
            slope = (up - loss()) / 2e-5
            start.w[layer][at] = held
            if abs(slope) > 1e-4:
                assert fitted.w[layer][at] == pytest.approx(held - 0.01 * np.sign(slope), abs=1e-5)


def test_equal_texts_and_scores_at_the_threshold(spark, corpus):
    docs, labels = corpus
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["th er on", "th er on", None, "", "idiot scum th"])], "doc_id long, text string")
    for classifier, model in ((quality, quality.fit(docs, labels, "quality")), (toxicity, toxicity.fit(docs, labels, "toxic"))):
        score = {r["doc_id"]: r["score"] for r in classifier.classify(rows, model, ["doc_id"]).collect()}
        assert score[0] == pytest.approx(score[1], rel=1e-9) and score[2] == pytest.approx(score[3], rel=1e-9)
    # a text without features scores the bias alone: a tie with the threshold is predicted
    at = {r["doc_id"]: r["predicted"] for r in toxicity.classify(rows, model, ["doc_id"], threshold=score[2]).collect()}
    assert at[2] == at[3] == 1 and at == {k: int(s >= score[2]) for k, s in score.items()}
