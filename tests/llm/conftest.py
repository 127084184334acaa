import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, size long, piece int"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "de": "sch ein ich der ung die und ver ten gen ach für über zu".split()}


def words(r, lang, n):
    return [("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3)))) for _ in range(n)]


def bodies():
    """(text, lang, quality, toxic) of a small corpus with clean, junk, repetitive and toxic documents."""
    r = random.Random(7)
    out = []
    for k in range(260):
        lang = "en" if k % 3 else "de"
        w = words(r, lang, r.randint(30, 120))
        quality, toxic = 1, 0
        if k % 7 == 0:
            w, quality = [x + r.choice(["###", "&&&", "%%%"]) for x in w], 0
        elif k % 11 == 0:
            w, quality = [x for x in w[:8] for _ in range(12)], 0
        if k % 4 == 1:
            toxic = 1
            for bad in ("idiot", "moron", "scum"):
                w.insert(r.randrange(len(w)), bad)
        out.append((" ".join(w), lang, quality, toxic))
    return out


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with extra columns named like results, and labels."""
    rows = [(k, t, lang, f"s{k % 5}", len(t), 9.0, 9, 9, 9) for k, (t, lang, _, _) in enumerate(bodies())]
    labels = [(k, q, t) for k, (_, _, q, t) in enumerate(bodies())]
    return spark.createDataFrame(rows, DOCS).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and very long texts, null and repeated ids, repeated rows, null language and source."""
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "the same text here"), (5, "the same text here"), (None, "text without an id"), (None, None), (6, "### !!! 123"), (7, "ünï Çödé 🙂 words"), (8, "word"), (9, "a\x00b <|endoftext|> c")]
    return spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, None, None, None, None) for k, (i, t) in enumerate(rows)], DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
