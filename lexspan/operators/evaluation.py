"""Measuring: predictions against a reference sample, extracted text against an independent reading, metrics against golden ones."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_lower, words

#: Verdict thresholds. Fixed values.
COVERAGE_OK, COVERAGE_FAIL, EXCESS_OK, ORDER_OK, REVERSED_FAIL = 0.995, 0.97, 0.005, 0.97, 5
#: Pairs of equal places from which on, and up to which, they are held as arrays (16 bytes each, some more while they are made); others are looked for stretch by stretch.
FEW_PAIRS, MANY_PAIRS = 500, 2_000_000


def overlaps(a: Column, b: Column) -> Column:
    """Two normalised texts overlap: one holds the other, or the shorter's head (max(40, a third) characters) lies in the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    head = F.left(short, F.greatest(F.lit(40), F.floor(F.length(short) / 3).cast("int")))
    return (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b) | F.contains(long, head))


def head(c: str) -> Column:
    return F.left(c, F.greatest(F.lit(40), F.floor(F.length(c) / 3).cast("int")))


def overlapping(items: DataFrame, item: str, a: str, rows: DataFrame, row: list[str], b: str, piece: int = 8) -> DataFrame:
    """(item, row) of all texts that overlap, whichever is the shorter; texts are normalised, blank ones overlap with nothing.

    An overlap means that the longer text holds the shorter one's head. Heads of rows meet the items by their first ``piece`` characters at all places of the items (shorter heads
    by themselves); heads of items meet the rows by their rarest inner word, which the row must hold whole. Only items whose head has no inner word
    meet by pieces at all places of the rows. Words and pieces of rows are dealt as hashes with the hash of their row, never with its text; the rows' own texts are dealt once for either way, and decide.
    """
    items, rows = items.select(item, a).filter(F.col(a) != ""), rows.select(*row, b).filter(F.col(b) != "")
    places = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(n)))
    pieces = lambda df, c, sizes: df.withColumn("__k", F.explode(F.array_distinct(F.flatten(F.array(*[places(c, n) for n in sizes])))))
    key = lambda c: F.left(head(c), F.lit(piece))
    # the row is the shorter one: none that is longer than all items is dealt
    size = F.broadcast(items.agg(F.max(F.length(a)).alias("__l")))
    heads = rows.crossJoin(size).filter(F.length(b) <= F.col("__l")).drop("__l").withColumn("__k", key(b))
    held = pieces(items.select(a).distinct(), a, range(1, piece + 1)).join(heads, "__k").filter((F.length(b) <= F.length(a)) & F.contains(F.col(a), head(b))).select(a, *row)
    # the item is the shorter one
    hashes = lambda ws: F.explode(F.array_distinct(F.transform(ws, lambda w: F.xxhash64(w)))).alias("__k")
    inner = items.select(a).distinct().withColumn("__w", F.split(head(a), " ")).withColumn("__w", F.slice("__w", 2, F.greatest(F.size("__w") - 2, F.lit(0))))
    words = rows.select(F.xxhash64(b).alias("__h"), hashes(F.split(b, " ")))
    wanted = inner.select(a, hashes(F.col("__w")))
    count = words.groupBy("__k").agg(F.count("*").alias("__n")).join(wanted.select("__k").distinct(), "__k")
    rarest = wanted.join(count, "__k", "left").groupBy(a).agg(F.min_by("__k", F.struct(F.coalesce("__n", F.lit(0)), "__k")).alias("__k"))
    near = rarest.join(words, "__k").select(a, "__h")
    bare = inner.filter(F.size("__w") == 0).select(a).withColumn("__k", F.xxhash64(key(a)))
    if not bare.isEmpty():
        near = near.unionByName(rows.select(F.xxhash64(b).alias("__h"), hashes(F.flatten(F.array(*[places(b, n) for n in range(1, piece + 1)])))).join(bare, "__k").select(a, "__h"))
    shorter = near.distinct().join(rows.withColumn("__h", F.xxhash64(b)), "__h").filter((F.length(a) <= F.length(b)) & F.contains(F.col(b), head(a))).select(a, *row)
    return items.join(held.unionByName(shorter), a).select(item, *row).distinct()


def pair_states(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, code, in_predicted, in_gold, overlap): distinct pairs of either side; overlap if any texts of a pair overlap.

    ``predicted`` has (doc_id, code, text), ``gold`` (doc_id, code, segment). Texts are compared within a pair only, by an equi-join.
    """
    p = predicted.select("doc_id", "code").distinct().withColumn("in_predicted", F.lit(True))
    g = gold.select("doc_id", "code").distinct().withColumn("in_gold", F.lit(True))
    near = predicted.select("doc_id", "code", plain_lower("text").alias("a")).join(gold.select("doc_id", "code", plain_lower("segment").alias("b")), ["doc_id", "code"]).filter(overlaps(F.col("a"), F.col("b"))).select("doc_id", "code").distinct().withColumn("overlap", F.lit(True))
    no = F.lit(False)
    return p.join(g, ["doc_id", "code"], "full_outer").join(near, ["doc_id", "code"], "left").select("doc_id", "code", *[F.coalesce(c, no).alias(c) for c in ("in_predicted", "in_gold", "overlap")])


def scores(states: DataFrame, by_code: bool = True) -> DataFrame:
    """True and false positives, false negatives, precision, recall, F1 by code, or over all codes (without F1).

    Undefined ratios are null; F1 is 0 if precision or recall is null or 0.
    """
    count = lambda e: F.coalesce(F.count_if(F.expr(e)), F.lit(0))
    groups = states.groupBy("code") if by_code else states.groupBy()
    out = groups.agg(count("in_predicted and in_gold").alias("tp"), count("in_predicted and not in_gold").alias("fp"), count("in_gold and not in_predicted").alias("fn"), count("in_predicted and in_gold and overlap").alias("tp_segment"), count("in_gold").alias("n_reference"))
    out = out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    if not by_code:
        return out.drop("n_reference")
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def word_counts(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, word, n): the multiset of words of each document."""
    return docs.select(*key, F.explode(words(text)).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))


def word_differences(reference: DataFrame, extracted: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, word, missing, extra): positive parts of the differences of word counts, rows with a difference only."""
    a, b = word_counts(reference, key, text).withColumnRenamed("n", "__a"), word_counts(extracted, key, text).withColumnRenamed("n", "__b")
    both = a.join(b, [*key, "word"], "full_outer").select(*key, "word", F.coalesce("__a", F.lit(0)).alias("__a"), F.coalesce("__b", F.lit(0)).alias("__b"))
    return both.select(*key, "word", F.greatest(F.col("__a") - F.col("__b"), F.lit(0)).alias("missing"), F.greatest(F.col("__b") - F.col("__a"), F.lit(0)).alias("extra")).filter("missing + extra > 0")


def coverage(reference: DataFrame, extracted: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, words_ref, words_text, missing, extra, coverage, excess): shares of words lost and added. Empty sides give 1 and 0."""
    a, b = word_counts(reference, key, text).withColumnRenamed("n", "__a"), word_counts(extracted, key, text).withColumnRenamed("n", "__b")
    both = a.join(b, [*key, "word"], "full_outer").select(*key, F.coalesce("__a", F.lit(0)).alias("a"), F.coalesce("__b", F.lit(0)).alias("b"))
    out = both.groupBy(*key).agg(F.sum("a").alias("words_ref"), F.sum("b").alias("words_text"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))
    return out.withColumn("coverage", F.when(F.col("words_ref") > 0, 1 - F.col("missing") / F.col("words_ref")).otherwise(1.0)).withColumn("excess", F.when(F.col("words_text") > 0, F.col("extra") / F.col("words_text")).otherwise(0.0))


def verdict(coverage: Column, excess: Column, order: Column | None = None, reversed_words: Column | None = None, residues: Column | None = None, error: Column | None = None, excluded: Column | None = None) -> Column:
    """EXCLUDED, UNMEASURED, FAIL, ATTENTION or OK, in this order of precedence."""
    order, reversed_words, residues = order if order is not None else F.lit(1.0), reversed_words if reversed_words is not None else F.lit(0), residues if residues is not None else F.lit(0)
    out = F.when(excluded.isNotNull(), "EXCLUDED") if excluded is not None else F.when(F.lit(False), "EXCLUDED")
    if error is not None:
        out = out.when(error.isNotNull(), "UNMEASURED")
    out = out.when((coverage < COVERAGE_FAIL) | (reversed_words >= REVERSED_FAIL), "FAIL")
    return out.when((coverage < COVERAGE_OK) | (excess > EXCESS_OK) | (order < ORDER_OK) | (reversed_words > 0) | (residues > 0), "ATTENTION").otherwise("OK")


def page_loss(pages: DataFrame, extracted: DataFrame, key: list[str], page: str, text: str = "text") -> DataFrame:
    """(key, page, n_words, lost, loss): pages take the words that they find in the text, in page order; what isn't left is lost.

    The r-th occurrence of a word on a document's pages is found if the text has it r times. A page has its occurrences counted first, so
    the window orders (word, page) rows, not words. Whole texts are dealt by document once, and become words only after that: all that follows stays where it is.
    """
    known = extracted.filter(" and ".join(f"`{k}` is not null" for k in key)).select(*key, F.lit(None).cast(pages.schema[page].dataType).alias(page), F.col(text).alias("__t"), F.lit(True).alias("__whole"))
    both = pages.select(*key, page, F.col(text).alias("__t"), F.lit(False).alias("__whole")).unionByName(known).repartition(*key)
    per = both.select(*key, page, "__whole", F.explode(words("__t")).alias("word")).groupBy(*key, page, "__whole", "word").agg(F.count("*").alias("n"))
    # the text's own count comes first
    before = Window.partitionBy(*key, "word").orderBy(F.desc("__whole"), page).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda whole: F.coalesce(F.sum(F.when(F.col("__whole") == whole, F.col("n"))).over(before), F.lit(0))
    counted = per.withColumns({"__have": upto(True), "__before": upto(False)}).filter(~F.col("__whole"))
    found = F.greatest(F.least(F.col("n"), F.col("__have") - F.col("__before")), F.lit(0))
    out = counted.withColumn("__found", found)
    return out.groupBy(*key, page).agg(F.sum("n").alias("n_words"), F.sum(F.col("n") - F.col("__found")).alias("lost")).withColumn("loss", F.col("lost") / F.col("n_words"))


def top_words(differences: DataFrame, key: list[str], what: str, most: int = 25) -> DataFrame:
    """The ``most`` words of each key with the highest counts, ties by word."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(what), "word"))
    return differences.filter(F.col(what) > 0).withColumn("rank", rank).filter(F.col("rank") <= most).select(*key, "rank", "word", what)


def places_of(b: Sequence, autojunk: bool = True) -> dict:
    """The places of b's elements that can start a match."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if autojunk and len(b) >= 200:
        places = {x: js for x, js in places.items() if len(js) <= len(b) // 100 + 1}
    return places


def longest(a: Sequence, at: list[int], places: dict, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """Where the longest run of equal elements of a stretch begins in a and in b, and its size; of equal ones the first."""
    i, j, size, before, run = alo, blo, 0, -2, {}
    for k in range(bisect_left(at, alo), bisect_left(at, ahi)):
        now, js, new = at[k], places[a[at[k]]], {}
        if now != before + 1:
            run = {}
        for y in js[bisect_left(js, blo) : bisect_left(js, bhi)]:
            n = new[y] = run.get(y - 1, 0) + 1
            if n > size:
                i, j, size = now - n + 1, y - n + 1, n
        before, run = now, new
    return i, j, size


class Runs:
    """Pairs of equal places of two sequences, in order, with the length of the run of pairs that each ends; a stretch's bounds cut runs where they begin."""

    def __init__(self, a: Sequence, at: list[int], places: dict):
        arrays = {x: np.array(places[x], np.int32) for x in {a[i] for i in at}}
        js = [arrays[a[i]] for i in at]
        counts = np.array([len(x) for x in js])
        self.at, self.first = at, [0, *np.cumsum(counts).tolist()]
        self.i, self.j = np.repeat(np.array(at, np.int32), counts), np.concatenate(js)
        diagonal = self.j - self.i
        order = np.argsort(diagonal, kind="stable")
        i, d = self.i[order], diagonal[order]
        start = np.ones(len(i), bool)
        start[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
        places_ = np.arange(len(i), dtype=np.int32)
        self.n = np.empty(len(i), np.int32)
        self.n[order] = places_ - np.maximum.accumulate(np.where(start, places_, 0)) + 1

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        lo, hi = self.first[bisect_left(self.at, alo)], self.first[bisect_left(self.at, ahi)]
        if lo == hi:
            return alo, blo, 0
        i, j = self.i[lo:hi], self.j[lo:hi]
        n = np.minimum(np.minimum(self.n[lo:hi], i - (alo - 1)), j - (blo - 1))
        n[j >= bhi] = 0
        k = int(n.argmax())
        size = int(n[k])
        return (int(i[k]) - size + 1, int(j[k]) - size + 1, size) if size > 0 else (alo, blo, 0)


def matched(a: Sequence, b: Sequence, autojunk: bool = True, need: int = 0, places: dict | None = None) -> int:
    """Elements in difflib's matching blocks of a and b: the sum of their sizes, without building them; -1 if they are fewer than ``need``.

    The same blocks as ``SequenceMatcher(None, a, b, autojunk)``. Only places of a that can start a match are looked at, and of b only
    those in range, which spares most steps where the frequent elements are junk. Memory follows the lengths, not their product.
    What the stretches that are still open can hold bounds the sum, so a pair that can't reach ``need`` ends early. ``places`` are those of b, if known.
    Where equal places are neither few nor too many to hold, ``Runs`` has them counted once for all stretches.
    """
    if a == b:
        return len(a) if len(a) >= need else -1
    places = places_of(b, autojunk) if places is None else places
    at = [i for i, x in enumerate(a) if x in places]
    runs = Runs(a, at, places) if FEW_PAIRS <= sum(len(places[a[i]]) for i in at) <= MANY_PAIRS else None
    total, todo, open_ = 0, [(0, len(a), 0, len(b))], min(len(a), len(b))
    while todo:
        if total + open_ < need:
            return -1
        alo, ahi, blo, bhi = todo.pop()
        open_ -= min(ahi - alo, bhi - blo)
        i, j, size = runs.longest(alo, ahi, blo, bhi) if runs else longest(a, at, places, alo, ahi, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
                open_ += min(i - alo, j - blo)
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
                open_ += min(ahi - i, bhi - j) - size
    return total if total >= need else -1


def order_ratio(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, order_ratio, similarity): matched words in order over the reference's words (without junk heuristics), and difflib's ratio of the whole texts, both without accents, case and
    repeated white space."""
    schema = pairs.select(*key).schema.add("order_ratio", "double").add("similarity", "double")

    def run(frames):
        import re

        from .diff import comparable

        for frame in frames:
            order, alike = [], []
            for x, y in zip(frame["__a"], frame["__b"]):
                x, y = x or "", y or ""
                u, v = re.findall(r"\w+", x), re.findall(r"\w+", y)
                order.append(matched(u, v, autojunk=False) / len(u) if u and v else 1.0)
                x, y = comparable(x), comparable(y)
                alike.append(2.0 * matched(x, y) / (len(x) + len(y)) if x or y else 1.0)
            yield pd.concat([frame[key].reset_index(drop=True), pd.DataFrame({"order_ratio": order, "similarity": alike})], axis=1)

    return pairs.select(*key, F.col(a).alias("__a"), F.col(b).alias("__b")).mapInPandas(run, schema)


def rejoined_pages(pages: DataFrame, key: list[str], page: str, text: str = "text") -> DataFrame:
    """Pages with a word that a page's end splits (a hyphen there, a lower-case beginning on the next page) written whole on the page where it starts."""
    w = Window.partitionBy(*key).orderBy(page)
    clean = F.regexp_replace(text, r"(?U)\s+$", "")
    rows = pages.withColumn("__t", clean).withColumn("__open", F.col("__t").rlike("(-|\ufffe)$"))
    head = F.regexp_extract(F.regexp_replace("__t", r"(?U)^\s+", ""), r"(?U)^[a-zà-ÿ]\w*", 0)
    rows = rows.withColumn("__head", head).withColumn("__takes", F.coalesce(F.lag("__open").over(w), F.lit(False)) & (F.col("__head") != ""))
    rest = F.when(F.col("__takes"), F.substr(F.regexp_replace("__t", r"(?U)^\s+", ""), F.length("__head") + 1)).otherwise(F.col("__t"))
    given = F.lead(F.when(F.col("__takes"), F.col("__head"))).over(w)
    # a page that is nothing but the end of a word has no open word of its own left
    own_open = F.col("__open") & given.isNotNull()
    out = F.when(own_open & (F.length(rest) > 0), F.concat(F.left(rest, F.length(rest) - 1), given)).otherwise(rest)
    return rows.withColumn(text, out).drop("__t", "__open", "__head", "__takes")


def longest_fragments(fragments: DataFrame, key: list[str], length: str, order: str, most: int = 12, least: int = 4) -> DataFrame:
    """The ``most`` longest fragments (of ``least`` words or more) of each key, ties in their order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(length), order))
    return fragments.filter(F.col(length) >= least).withColumn("rank", rank).filter(F.col("rank") <= most)


def gate(now: DataFrame, golden: DataFrame, key: list[str], directions: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, metric, before, now, state): REGRESSION, improved or same, by each metric's direction and tolerance.

    '+' fails below before - tolerance, '-' above before + tolerance, '=' on any change; keys without a golden row are left out. Both tables have
    (key, metric, value).
    """
    rules = F.create_map(*[F.lit(x) for m, (d, _) in directions.items() for x in (m, d)])
    slack = F.create_map(*[x for m, (_, t) in directions.items() for x in (F.lit(m), F.lit(float(t)))])
    both = now.withColumnRenamed("value", "now").join(golden.withColumnRenamed("value", "before"), [*key, "metric"]).filter(F.col("metric").isin(*directions))
    d, t = F.element_at(rules, F.col("metric")), F.element_at(slack, F.col("metric"))
    worse = F.when(d == "+", F.col("now") < F.col("before") - t).when(d == "-", F.col("now") > F.col("before") + t).otherwise(F.col("now") != F.col("before"))
    better = F.when(d == "+", F.col("now") > F.col("before")).when(d == "-", F.col("now") < F.col("before")).otherwise(F.lit(False))
    return both.select(*key, "metric", "before", "now", F.when(worse, "REGRESSION").when(better, "improved").otherwise("same").alias("state"))


def performance(runs: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, pages, seconds_per_page, start_up, peak_mb) of measured documents with (pages, seconds, start_s, rss_mb)."""
    out = runs.groupBy(*key).agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds"), F.median("start_s").alias("start_up"), F.max("rss_mb").alias("peak_mb"))
    return out.withColumn("seconds_per_page", F.try_divide("seconds", "pages")).drop("seconds")


def performance_regressions(now: DataFrame, before: DataFrame, key: list[str], tolerance: float = 0.15, budget: float | None = None) -> DataFrame:
    """Rows slower than the reference by more than ``tolerance``, or above an approved budget."""
    both = now.join(before.select(*key, F.col("seconds_per_page").alias("before")), key, "left")
    slow = F.col("seconds_per_page") > F.col("before") * (1 + tolerance)
    return both.filter(F.coalesce(slow, F.lit(False)) | (F.lit(False) if budget is None else F.col("seconds_per_page") > budget))
