"""Acronyms of organisations: ambiguous ones, and an assignment without duplicates by a fixed ladder."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import acronym, lineage, numeric_order
from .registry import GENERIC_WORDS, LEGAL_FORMS, LINK_WORDS, camel

# Lengths that file names allow, and words that many names of a branch share, which are used last.
LONGEST, LEAST_BASE, LONGEST_SUFFIX, LONGEST_OVERLAPPING_BASE, LONGEST_OVERLAP, STEM = 20, 6, 12, 8, 3, 6
WEAK_WORDS = (
    "comercial comerciais industrial industriais empresarial empresariais empresas empresa servicos servico regional regionais distrital distritais concelhia concelhias "
    "geral gerais norte sul centro outros outras concelhos concelho regiao zona area sector setor actividade atividade actividades atividades democratico democratica "
    "independente independentes livre livres"
).split()


def ambiguous(orgs: DataFrame) -> DataFrame:
    """(acronym, n_lineages, names): acronyms, in any case, that organisations of more than one lineage use."""
    rows = orgs.filter(F.coalesce("base", F.lit("")) != "").select(F.upper("base").alias("acronym"), lineage("code").alias("l"), "name")
    out = rows.groupBy("acronym").agg(F.count_distinct("l").alias("n_lineages"), F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("names"))
    return out.filter("n_lineages > 1")


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def telling_words(name: str) -> list[str]:
    """A name's words of three letters or more that tell it apart, capitalised; those that tell little come last, link words, legal forms and generic words not at all."""
    skipped = {*LINK_WORDS, *LEGAL_FORMS, *GENERIC_WORDS}
    found = dict.fromkeys(w.capitalize() for w in re.findall(r"\w{3,}", plain(name)) if w.lower() not in skipped)
    return sorted(found, key=lambda w: w.lower() in WEAK_WORDS)


def extended(base: str, word: str) -> str:
    """Base and word within LONGEST characters. What the end of a short base shares with the word's beginning is written once; where both don't fit, the
    base gives way, for the word is what tells two apart."""
    shared = range(min(LONGEST_OVERLAP, len(base), len(word) - 1) if len(base) <= LONGEST_OVERLAPPING_BASE else 0, 0, -1)
    word = word[next((n for n in shared if base.lower().endswith(word[:n].lower())), 0) :][:LONGEST_SUFFIX]
    room = max(LEAST_BASE, LONGEST - len(word)) if len(base) + len(word) > LONGEST else len(base)
    return (base[:room] + word)[:LONGEST]


def ladder(base: str, name: str, municipality: str, code: str) -> list[str]:
    """Candidates for an acronym: the base, with the most telling word, with the seat, with the two most telling words, and with the code, which is unique."""
    words, digits = telling_words(name), re.sub(r"\D", "", code)
    seat = re.sub(r"[^A-Za-z0-9]", "", plain(municipality).strip().capitalize())
    endings = [*words[:1], *([seat] if seat else []), *(["".join(words[:2])] if len(words) > 1 else [])]
    return list(dict.fromkeys([base[:LONGEST], *(extended(base, e) for e in endings), base[: LONGEST - len(digits)] + digits]))


def oldest_first(code: str) -> tuple:
    return tuple(int(x) if x.isdigit() else 0 for x in code.split("."))


def stems(c: str):
    """Prefixes of a name's stem, the shortest first."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(STEM))), lambda n: F.upper(F.left(F.col(c), n)))


def assign(orgs: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(lineage, base, acronym) without duplicates in any case. ``orgs`` has (code, name, base, municipality, last_activity).

    The generations of a lineage share an acronym; a lineage's claim is told by its latest generation. Without a base the name's short form is claimed. Fixed acronyms
    (lineage, base, acronym) of a claim never change. A base that one lineage claims and nobody holds is settled natively. The rest, collisions alone, is a greedy pass: the oldest
    lineage first, each up its ladder until a free step. All steps of a ladder begin with the first STEM characters of its base, so the pass runs by
    stem (a stem that begins with another one goes with it), beside the taken acronyms that begin so.
    """
    own = F.coalesce(F.nullif(acronym("base", LONGEST), F.lit("")), camel("name"))
    newest = F.struct(F.coalesce("last_activity", F.lit("")), numeric_order("code"))
    claims = orgs.withColumns({"lineage": lineage("code"), "base": own}).groupBy("lineage", "base").agg(F.max_by(F.struct("name", "municipality", "code"), newest).alias("x")).select("lineage", "base", "x.*", F.upper("base").alias("u"))
    held = orgs.sparkSession.createDataFrame([], "lineage string, base string, acronym string")
    if fixed is not None:
        first = fixed.filter(F.coalesce("acronym", F.lit("")) != "").join(claims.select("lineage", "base"), ["lineage", "base"], "left_semi").groupBy(F.upper("acronym").alias("u"))
        held = first.agg(F.min(F.struct(numeric_order("lineage"), "lineage", "base", "acronym")).alias("x")).select("x.lineage", "x.base", "x.acronym")
        claims = claims.join(held.select("lineage", "base"), ["lineage", "base"], "left_anti")
    taken = held.select(F.upper("acronym").alias("u"), F.lit(True).alias("taken"))
    # a lineage may claim one base in two spellings: the first is settled, the other collides
    n = claims.groupBy("u").agg(F.count_distinct("lineage").alias("n"), F.min(F.struct("lineage", "base")).alias("least"))
    marked = claims.join(n, "u").join(taken, "u", "left").withColumn("alone", (F.col("n") == 1) & F.col("taken").isNull() & (F.struct("lineage", "base") == F.col("least")))
    settled = marked.filter("alone").select("lineage", "base", F.left("base", F.lit(LONGEST)).alias("acronym"))
    rest = marked.filter("not alone").select("lineage", "base", "name", "municipality", "code", F.lit(None).cast("string").alias("acronym"))
    roots = rest.select(F.upper(F.left("base", F.lit(STEM))).alias("stem")).distinct()
    by_root = lambda df, c: df.withColumn("stem", F.explode(stems(c))).join(roots, "stem").groupBy(*df.columns).agg(F.min(F.struct(F.length("stem"), "stem"))["stem"].alias("root"))
    near = by_root(settled.unionByName(held), "acronym").select("lineage", "base", *[F.lit("").alias(c) for c in ("name", "municipality", "code")], "acronym", "root")
    both = by_root(rest, "base").unionByName(near)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        used = {a.upper() for a in frame["acronym"].dropna()}
        todo = frame[frame["acronym"].isna()].fillna("")
        out = []
        for r in sorted(todo.itertuples(index=False), key=lambda r: (oldest_first(r.lineage), r.base)):
            steps = iter(ladder(r.base, r.name, r.municipality, r.code))
            got, k = next(steps), 1
            while got.upper() in used:
                got = next(steps, None)
                if got is None:
                    k += 1
                    got = r.base[: LONGEST - 2] + str(k)
            used.add(got.upper())
            out.append((r.lineage, r.base, got))
        return pd.DataFrame(out, columns=["lineage", "base", "acronym"])

    greedy = both.groupBy("root").applyInPandas(run, "lineage string, base string, acronym string")
    return settled.unionByName(greedy).unionByName(held)
