"""Operators 9 and 10, and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lexspan.llm import ctw, html_text


def kt(a, b):
    p = 1.0
    for i in range(a):
        p *= (i + 0.5) / (i + 1)
    for j in range(b):
        p *= (j + 0.5) / (a + j + 1)
    return p


class SlowTree:
    """Context-tree weighting by its definition: block probabilities of all nodes, over explicit bit strings."""

    def __init__(self, streams, depth):
        self.depth, self.seen = depth, {}
        for s in streams:
            data = ctw.END * depth + s
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    for b in range(8):
                        node = (data[i - d : i], (1 << b) | (data[i] >> (8 - b)))
                        self.seen.setdefault(node, [0, 0])[data[i] >> (7 - b) & 1] += 1

    def weighted(self, context, prefix):
        a, b = self.seen.get((context, prefix), (0, 0))
        if len(context) == self.depth:
            return kt(a, b)
        product = 1.0
        for x in range(256):
            child = bytes([x]) + context
            if (child, prefix) in self.seen:
                product *= self.weighted(child, prefix)
        return 0.5 * kt(a, b) + 0.5 * product

    def p_one(self, context, prefix):
        """Probability of a one next, as the ratio of weighted block probabilities with and without it."""
        before = self.weighted(b"", prefix)
        for d in range(self.depth + 1):
            self.seen.setdefault((context[len(context) - d :], prefix), [0, 0])[1] += 1
        after = self.weighted(b"", prefix)
        for d in range(self.depth + 1):
            node = (context[len(context) - d :], prefix)
            self.seen[node][1] -= 1
            if self.seen[node] == [0, 0]:
                del self.seen[node]
        return after / before


def log10_of(streams, depth, root):
    """A function from a text's stream to its log10 probability, with the tree cut at ``root`` into a top and subtrees."""
    keys, n = np.unique(ctw.grams(streams, depth), return_counts=True)
    deep, (key, a, b, log_w) = ctw.grow(keys, n.astype(np.int64), depth, root)
    parts = []
    for d in range(root, 0, -1):
        key, a, b, below = ctw.summed(ctw.above(key, d), a, b, log_w)
        one, stop, log_w = ctw.weighed(a, b, below)
        parts.append((key, one, stop))
    top = ctw.Nodes(parts)
    return lambda keys: ctw.mixture(keys, depth, deep, top, root)


@pytest.mark.parametrize("root", [0, 1, 2])
def test_tree_against_the_definition(root):
    streams = [b"abab\n", b"abba\n", b"b\n"]
    depth = 2
    fast, slow = log10_of(streams, depth, root), SlowTree(streams, depth)
    for s in (b"abab\n", b"ba\n", b"c\n", b"aa\n"):
        data, total = ctw.END * depth + s, 0.0
        for i in range(depth, len(data)):
            for b in range(8):
                p = slow.p_one(data[i - depth : i], (1 << b) | (data[i] >> (8 - b)))
                total += math.log10(p if data[i] >> (7 - b) & 1 else 1 - p)
        assert fast(ctw.grams([s], depth)).sum() == pytest.approx(total, rel=1e-9)


def test_probabilities_of_all_bytes_sum_to_one():
    fast = log10_of([b"the cat\n", b"the hat\n"], 3, 2)
    for context in (b"the", b"\n\n\n", b"zzz"):
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert (10 ** fast(keys)).sum() == pytest.approx(1, rel=1e-9)


def test_table_finds_what_it_holds():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 50, 5000).astype(np.uint64))
    table = ctw.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 51)) == -1).all()
    assert (ctw.Table(keys[:0]).find(keys) == -1).all()


def test_kt_forms_agree():
    a, b = np.array([0, 3, 1000, 7, 70_000, 3_000_000]), np.array([0, 5, 2, 900, 65_536, 1])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(x + y + 1) for x, y in zip(a, b)]
    assert np.allclose(ctw.kt_log(a, b), want)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + ["\n"]


@pytest.mark.parametrize("most_words", [5, 100_000])  # 5: nearly all counts come by the join
def test_base_scores(spark, corpus, odd, most_words):
    docs = corpus[0]
    model, table = ctw.fit(docs, most_words=most_words, most_grams=2000)
    c = Counter(w for r in docs.collect() for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    both = docs.unionByName(odd)
    rows = ctw.score(both, model, table, ["doc_id", "text", "score"]).collect()
    assert len(rows) == both.count()
    for r in rows:
        w = words(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    half = docs.filter("doc_id % 2 = 0")
    model, table = ctw.fit(half)
    rest = docs.filter("doc_id % 2 = 1")
    flat, _ = ctw.fit(half, depth=0)
    deep, shallow = (ctw.score(rest, m, table, ["doc_id"]).toPandas()["score"].sum() for m in (model, flat))
    assert deep > 0.8 * shallow


@pytest.mark.parametrize("most_grams", [0, 300, 400_000])  # 0: every value comes by the join
def test_scores_are_those_of_the_whole_tree(spark, corpus, odd, most_grams):
    docs = corpus[0].limit(120)
    body = lambda r: ctw.stream(ctw.tokens(r["text"].encode() if r["text"] else b""))
    train = [body(r) for r in docs.collect()]
    fast = log10_of(train, 4, 2)
    model, counts = ctw.fit(docs, depth=4, most_grams=most_grams)
    assert len(model.value) <= most_grams
    both = corpus[0].unionByName(odd).select("doc_id", "text")
    rows = ctw.score(both, model, counts, ["doc_id", "text"]).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert r["score"] == pytest.approx(fast(ctw.grams([body(r)], 4)).sum(), rel=1e-8)


def test_the_tree_grows_with_the_corpus(spark, corpus):
    small, large = (ctw.fit(d)[1].filter("gram is not null").count() for d in (corpus[0].limit(60), corpus[0]))
    assert large > 1.5 * small


def test_model_of_nothing(spark, empty, odd):
    model, table = ctw.fit(empty)
    assert ctw.score(odd, model, table, ["doc_id"]).count() == 12
    assert ctw.score(empty, model, table, ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>one</div><div>two<br>three</div>", "one\ntwo\nthree"),
        ("<title>t</title><style>x{}</style><script>if(a<b){'</p>'}</script>seen", "seen"),
        ("<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no</p><p>yes", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>a<li>b<li value=9>c</ol>", "3. a\n4. b\n9. c"),
        ("<table><tr><th>n<th>value<tr><td>long name<td>1<tr><td>x<td>22</table>", "n          value\nlong name  1\nx          22"),
        ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>w<td>d</table>", "a  b  c\nw     d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><caption>cap</caption><tr><td>a</table>", "cap\na"),
        ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
        ("&lt;b&gt; &amp; &eacute;&nbsp;x", "<b> & é x"),
        ("x<!-- no <p> -->y<!DOCTYPE html>", "xy"),
        ("<p>a</div></span>b</p>c", "ab\n\nc"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
        ("<blockquote>q</blockquote>r", "    q\n\nr"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<a href='x>y'>link</a>", "link"),
        ("<b>bo<i>th</b> x</i>", "both x"),
        ("<p>unclosed <b", "unclosed <b"),
        ("<script>never closed <p>x", ""),
        ("<head><meta charset=utf-8><title>t</title><body>b", "b"),
        ("<select><option>a<option>b</select>z", "a z"),
        ("<select><option>a<option selected>b</select>z", "b z"),
        ("<select multiple><option>a<optgroup><option>b</select>z", "a b z"),
        ("<button>Go</button> <textarea>\nl1\nl2</textarea>", "Go l1\nl2"),
        ("<input value=v> <input type=hidden value=no><input type=checkbox value=no><input type=submit value='Send it'>", "v Send it"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> <svg><title>no</title><text>s</text></svg>", "x=1 s"),
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b hidden>no</b></div>z", "yes\n\nz"),
        ("<style>.no, #x, td.no{display:none} p.gone{visibility:hidden} @media print{b{display:none}} i{color:red}</style><p class='a no'>1<p id=x>2<p class=gone>3<b>4</b><i>5</i></p><b>6</b><i>7</i>", "67"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e</table>", "a  b\n   c\n   d\ne"),
        ("<table><tr><td rowspan=99999>a<td colspan=1000>b<tr><td>c</table>", "a  b\n   c"),
        ("<p title=it's>a</p><p title='it>b'>c</p>", "a\n\nc"),
        ("<p title=\"x>y</p>z", "y\n\nz"),
        ("I </3 <!>you<!--->!", "I </3 you!"),
        ("<h1>T</h1>text<hr>more", "T\n\ntext\n\nmore"),
    ],
)
def test_rendering(html, want):
    assert html_text.extract(html) == want


def test_html_never_fails_and_loses_no_visible_word():
    import random

    r = random.Random(2)
    tags = "p div b i ul li ol table tr td th br span h1 section pre blockquote dl dd dt a tbody caption".split()
    for _ in range(300):
        parts, seen = [], []
        for k in range(r.randint(1, 40)):
            tag = r.choice(tags)
            parts.append(f"<{'/' if r.random() < 0.4 else ''}{tag}>")
            if r.random() < 0.6:
                seen.append(f"w{k}")
                parts.append(f"w{k} ")
        text = html_text.extract("".join(parts))
        assert sorted(re.findall(r"w\d+", text)) == sorted(seen), "".join(parts)
    assert len(html_text.extract("<div>" * 20_000 + "deep")) == 4
    assert html_text.extract("<table>" * 400 + "x")
    assert html_text.extract("<div>" * 300 + "<p hidden>no<b>no</b></p>yes") == "yes"


@pytest.mark.parametrize("part", ["<a href=\"", "<a href='x", "<a b=\"x>", "<!--", "<!-- >", "<div>", "<p><b>", "<td rowspan=9>", "</p>", "<body class=x>", "<", "</", "<a ", "<li>", "<script>", "<table><tr><td>", "<p style='visibility:hidden'>", "&", "<style>.a{", "<a b = "])
def test_time_follows_the_length_of_a_hostile_page(part):
    import time

    started = time.process_time()
    html_text.extract(part * (1_000_000 // len(part)))
    assert time.process_time() - started < 20, part


def test_unclosed_quotes_are_scanned_once():
    import time

    started = time.process_time()
    html_text.extract('<a href="' * 111_111)
    html_text.extract('<a href="' * 111_111 + ">")
    assert time.process_time() - started < 2


def test_random_trees_against_a_plain_walk():
    """Words of a tree in the order of a walk that knows only of hidden, display and visibility."""
    import random

    r = random.Random(5)

    def make(depth, laid, visible, out):
        n = f"w{len(out)}"
        tag, hide, see = r.choice(["div", "p", "span", "b", "section", "li", "h2", "button"]), r.random() < 0.1, r.choice(["", "", "", "hidden", "visible"])
        laid, visible = laid and not hide, visible if not see else see == "visible"
        out.append((n, laid and visible))
        style = ";".join(x for x in ("color:red", "display:none" if hide else "", f"visibility:{see}" if see else "") if x)
        inner = "".join(make(depth + 1, laid, visible, out) for _ in range(r.randint(0, 3) if depth < 5 else 0))
        return f'<{tag} title="a>b" style="{style}"> {n} {inner}</{tag}>'

    for _ in range(200):
        out: list[tuple[str, bool]] = []
        # blocks within p, li or h2 would end them: those are written as divs here
        html = re.sub(r"<(/?)(p|li|h2|button)\b", r"<\1div", make(0, True, True, out))
        order = re.findall(r"w\d+", html)
        want = [w for w in order if dict(out)[w]]
        assert re.findall(r"w\d+", html_text.extract(html)) == want, html


def test_html_table(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, None), (None, "", "y"), (3, "<p>" + "word " * 200_000, "z")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"), ["page_id", "text"]).collect()
    assert sorted(len(r["text"]) for r in out) == [0, 0, 1, 1, 999_999]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, corpus, tmp_path):
    import corpus_pipeline

    docs, labels = corpus

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(900, "12345 678 !!", "en", "s1", 12), (901, plain.first()["text"], "en", "s1", 5), (902, None, None, None, None)], plain.schema)
    plain.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.columns
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(at.count())
        if k < 4:
            assert at.columns == before
        ids = {r[0] for r in at.select("doc_id").collect()}
        if name == "language":
            assert 900 not in ids and 902 not in ids and 901 in ids
        if name == "near_duplicates":
            assert 901 not in ids
    assert sizes[0] == 261 and sizes[1] < sizes[0] and sizes[2] <= sizes[1]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == sizes[-1] and {"doc_id", "piece", "sequence_id"} <= set(whole.columns)


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
