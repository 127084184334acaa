"""Comparing versions of a document clause by clause."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import fold_text
from .evaluation import matched, places_of

#: Similarity from which bodies are equal, the same clause renumbered, and the same number is believed. Fixed values.
EQUAL, RENUMBERED, SAME_NUMBER, SAME_TITLE = 0.995, 0.75, 0.5, 0.8
SCHEMA = "new_label string, old_label string, class string, similarity double, renumbered boolean, diff string"


class Unmarked(dict):
    """For str.translate: combining marks go."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) == "Mn" else code
        return self[code]


UNMARKED = Unmarked()


def comparable(text: str) -> str:
    """Accents off, lower case, white space squeezed."""
    plain = text if text.isascii() else unicodedata.normalize("NFD", text).translate(UNMARKED)
    return re.sub(r"\s+", " ", plain.lower()).strip()


def share(n: int, size: int) -> float:
    return 2.0 * n / size if size else 1.0


def ratio(a: str, b: str, least: float = 0.0, places: dict | None = None) -> float:
    """difflib's ratio, or -1 if it is lower than ``least``."""
    size = len(a) + len(b)
    need = int(least * size / 2)
    while need and share(need - 1, size) >= least:
        need -= 1
    while share(need, size) < least:
        need += 1
    n = matched(a, b, need=need, places=places)
    return share(n, size) if n >= 0 else -1.0


def similarity(a: str, b: str) -> float:
    return ratio(comparable(a), comparable(b))


def line_diff(a: str, b: str) -> str:
    """Changed lines only, without file headers."""
    return "\n".join(list(difflib.unified_diff(a.strip().split("\n"), b.strip().split("\n"), lineterm="", n=0))[2:])


def body(text: str) -> str:
    """A clause without its label line; the line itself if there is no other."""
    _, mark, rest = text.partition("\n")
    return rest if mark else text


def most_alike(text: str, others: dict[int, str], least: float, letters: dict[int, Counter] | None = None) -> tuple[int, float] | None:
    """The most similar of the others and its ratio, the first of equals, if it reaches ``least``.

    Lengths bound a ratio from above, and so do counts of letters: others are tried from the highest bound down, until none can win. ``letters`` keeps the others' counts.
    """
    letters = {} if letters is None else letters
    bound = {j: share(min(len(o), len(text)), len(o) + len(text)) for j, o in others.items()}
    none = -len(others) - max(others, default=0) - 1
    best = (least, none)
    own = places = None
    for j in sorted(bound, key=lambda j: (-bound[j], j)):
        if bound[j] < best[0]:
            break
        if j not in letters:
            letters[j] = Counter(others[j])
        own, other = own or Counter(text), letters[j]
        few, many = (own, other) if len(own) < len(other) else (other, own)
        if share(sum([min(n, many[c]) for c, n in few.items() if c in many]), len(others[j]) + len(text)) >= best[0]:
            places = places_of(text) if places is None else places
            best = max(best, (ratio(others[j], text, best[0], places), -j))
    return None if best[1] == none else (-best[1], best[0])


def match_clauses(new: list[tuple], old: list[tuple]) -> list[tuple]:
    """Rows of SCHEMA for two lists of clauses (label, key, title, text) in order.

    A new clause takes the first free old one of its key if their bodies (SAME_NUMBER) or titles (SAME_TITLE) agree. What
    is left takes, in order, the free old clause that is most alike, from RENUMBERED on; the first of equals. Then new ones are new
    and old ones removed.
    """
    plain = {j: comparable(body(o[3])) for j, o in enumerate(old)}
    by_key: dict[str, list[int]] = {}
    for j, o in enumerate(old):
        by_key.setdefault(o[1], []).append(j)

    def pair(label: str, text: str, j: int, moved: bool, alike: float) -> tuple:
        del plain[j]
        same = alike >= EQUAL
        return (label, old[j][0], "=" if same else "alteracao", round(alike, 3), moved, "" if same else line_diff(body(old[j][3]), body(text)))

    rows, waiting, letters = [], [], {}
    for label, key, title, text in new:
        queue, own = by_key.get(key) if key else None, comparable(body(text))
        j = queue[0] if queue else None
        alike = ratio(plain[j], own, SAME_NUMBER) if j is not None else -1.0
        if j is not None and alike < 0 and title and similarity(title, old[j][2]) >= SAME_TITLE:
            alike = ratio(plain[j], own)
        if alike >= 0:
            rows.append(pair(label, text, queue.pop(0), False, alike))
        else:
            waiting.append((label, text, own))
    for label, text, own in waiting:
        found = most_alike(own, plain, RENUMBERED, letters)
        rows.append(pair(label, text, found[0], True, found[1]) if found else (label, None, "nova", 0.0, False, body(text).strip()[:600]))
    return rows + [(None, old[j][0], "removida", 0.0, False, body(old[j][3]).strip()[:600]) for j in sorted(plain)]


def compare_versions(new: DataFrame, old: DataFrame, pair: list[str]) -> DataFrame:
    """Clause by clause classes for pairs of versions: (pair, SCHEMA).

    ``new`` and ``old`` have (pair, ord, label, key, title, text). Clauses whose number occurs once in either version and whose bodies are equal are matched natively: nothing
    else could take them. Of the rest a match takes a clause from those that follow, so a pair's changed clauses are matched in one task; pairs are independent.
    """
    once = lambda df: df.withColumn("__n", F.when(F.col("key").isNotNull(), F.count("*").over(Window.partitionBy(*pair, "key"))))
    cut = F.regexp_replace("text", r"^[^\n]*\n", "")
    print_ = lambda df, side: df.filter("__n = 1").select(*pair, "key", F.col("label").alias(side), F.sha2(fold_text(cut), 256).alias("__h"))
    new, old = once(new), once(old)
    equal = print_(new, "new_label").join(print_(old, "old_label"), [*pair, "key", "__h"]).drop("__h")
    exact = equal.select(*pair, "new_label", "old_label", F.lit("=").alias("class"), F.lit(1.0).alias("similarity"), F.lit(False).alias("renumbered"), F.lit("").alias("diff"))
    fields = new.select(*pair).schema
    for f in SCHEMA.split(", "):
        fields = fields.add(*f.split(" "))
    sides = new.withColumn("__side", F.lit(1)).unionByName(old.withColumn("__side", F.lit(0))).drop("__n").join(equal.select(*pair, "key"), [*pair, "key"], "left_anti")

    held = sides.groupBy(*pair).agg(F.collect_list(F.struct("ord", "__side", "label", "key", "title", "text")).alias("__c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(fields)
        for batch in batches:
            for k in range(batch.num_rows):  # a pair at a time, so that memory follows its clauses
                *key, clauses = (c[k].as_py() for c in batch.columns)
                clauses.sort(key=itemgetter("ord"))
                part = lambda side: [(c["label"], c["key"], c["title"], c["text"]) for c in clauses if c["__side"] == side]
                found = [(*key, *r) for r in match_clauses(part(1), part(0))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), types)], schema=types)

    return exact.unionByName(held.select(*pair, "__c").mapInArrow(run, fields))


def comparison_clauses(nodes: DataFrame) -> DataFrame:
    """Leaf clauses and articles of each document; only the consolidated ones where they are half of them or more."""
    wanted = nodes.filter("leaf and type in ('clause', 'article')")
    share = wanted.groupBy("doc_id").agg((F.count_if(F.expr("origin = 'consolidated'")) * 2 >= F.count("*")).alias("__only"))
    return wanted.join(share, "doc_id").filter("not __only or origin = 'consolidated'").drop("__only")


def keyed_matches(new: DataFrame, old: DataFrame, pair: list[str], key: str) -> DataFrame:
    """(pair, key, new_ord, old_ord) of the first pass before corroboration: the k-th clause of a key in either version. Native."""
    rank = lambda df, name: df.filter(F.col(key).isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(*pair, key).orderBy("ord"))).select(*pair, key, "__k", F.col("ord").alias(name))
    return rank(new, "new_ord").join(rank(old, "old_ord"), [*pair, key, "__k"]).drop("__k")


def novel_clauses(diffs: DataFrame, nodes: DataFrame, doc: str = "new_doc") -> DataFrame:
    """(doc_id, clause_id): consolidated leaves of the new document whose label is altered or new."""
    changed = diffs.filter("class in ('alteracao', 'nova') and new_label is not null").select(F.col(doc).alias("doc_id"), F.col("new_label").alias("label")).distinct()
    wanted = nodes.filter("leaf and origin = 'consolidated' and type in ('clause', 'article')")
    return wanted.join(changed, ["doc_id", "label"], "left_semi").select("doc_id", F.col("node_id").alias("clause_id"))


def file_year(name: Column) -> Column:
    """The year that a file name tells, by its scheme."""
    part = lambda p: F.regexp_extract(name, p, 1)
    short = lambda p: F.when(part(p) != "", F.lit(2000) + part(p).cast("int"))
    return F.coalesce(F.when(name.rlike(r"^\d{1,2}_BTE_"), 2025), short(r"^(\d{2})_[A-Z]{2}_\d+_BTE_\d+_"), F.when(part(r"^(20\d{2})_BTE_\d+_") != "", part(r"^(20\d{2})_BTE_\d+_").cast("int")), short(r"^(\d{2})\d{3}_"), F.when(part(r"^(20\d{2})") != "", part(r"^(20\d{2})").cast("int")))


def choose_pair(versions: DataFrame, key: list[str], name: str, year: str, size: str) -> DataFrame:
    """(key, new, old): the longest version of the latest year, and of other years' the most recent whole one (half the longest version's size
    or more), else the most recent. Ties by name."""
    top = Window.partitionBy(*key)
    v = versions.withColumn("__most", F.max(size).over(top)).withColumn("__last", F.max(year).over(top))
    new = v.filter(F.col(year) == F.col("__last")).groupBy(*key).agg(F.max_by(name, F.struct(size, name)).alias("new"))
    whole = F.col(size) * 2 >= F.col("__most")
    old = v.filter(F.col(year) < F.col("__last")).groupBy(*key).agg(F.max_by(name, F.struct(whole, year, size, name)).alias("old"))
    return new.join(old, key, "left")
