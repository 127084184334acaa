"""Coding text spans from a declarative codebook, axis roll-up, drill-down, triage, and the model-assisted rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_array

#: Suggestions of a code count as automatic from this precision, measured on this many documents at least.
AUTO_PRECISION, AUTO_DOCUMENTS = 0.85, 2
#: Characters of clause text that one call to a model takes at most.
BATCH_CHARS = 12_000


@dataclass(frozen=True)
class Code:
    code: str
    terms: tuple[str, ...]
    requires_any: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Codebook:
    """Codes in order of precedence, and the axes (parent codes) that they roll up to. Lives on the driver and becomes literals of a plan."""

    codes: tuple[Code, ...]
    axes: tuple[str, ...] = field(default=())

    @classmethod
    def from_yaml(cls, path: str) -> Codebook:
        """Read a codebook file: axes with ids, codes with id, name, terms and conditions."""
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
        conditions = lambda c: c.get("condicoes") or c.get("conditions") or {}
        first = lambda d, *names: next((d[n] for n in names if d.get(n)), [])
        codes = tuple(Code(str(c["id"]), tuple(first(c, "termos", "terms")), tuple(first(conditions(c), "requer_algum", "requires_any")), tuple(first(conditions(c), "excluir", "excludes")), str(c.get("nome") or c.get("name") or "")) for c in first(data, "codigos", "codes"))
        return cls(codes, tuple(str(a["id"] if isinstance(a, dict) else a) for a in first(data, "eixos", "axes")))


def texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v.lower()) for v in values]) if values else F.expr("cast(array() as array<string>)")


def coded(spans: DataFrame, span: str, book: Codebook) -> DataFrame:
    """One row per span and matching code: the span's columns and (ord, code, n_hits, confidence, evidence).

    A code matches if one of its terms is a substring of the lower-cased span, one of ``requires_any`` is (if it has any) and none of
    ``excludes`` is. Confidence is 0.6, and 0.1 more for each further listed term found, 0.9 at most; evidence is the first
    term in list order. The codebook is a literal array, so this is a projection: no join, no shuffle, nothing to broadcast.
    """
    low = F.lower(span)
    has = lambda terms: F.filter(texts(terms), lambda t: F.contains(F.col("__low"), t))
    rows = []
    for k, c in enumerate(book.codes):
        good = F.lit(True)
        if c.requires_any:
            good = good & (F.size(has(c.requires_any)) > 0)
        if c.excludes:
            good = good & (F.size(has(c.excludes)) == 0)
        rows.append(F.when(good, F.struct(F.lit(k).alias("ord"), F.lit(c.code).alias("code"), has(c.terms).alias("hits"))))
    found = spans.withColumn("__low", low).withColumn("__m", F.filter(F.array(*rows), lambda r: F.size(r["hits"]) > 0))
    out = found.drop("__low").withColumn("__x", F.explode("__m")).drop("__m")
    kept = [c for c in spans.columns if c not in ("ord", "code", "n_hits", "confidence", "evidence")]
    n = F.size("__x.hits")
    return out.select(*kept, F.col("__x.ord").alias("ord"), F.col("__x.code").alias("code"), n.alias("n_hits"), F.least(F.lit(0.9), F.lit(0.6) + F.lit(0.1) * (n - 1)).alias("confidence"), F.element_at("__x.hits", 1).alias("evidence"))


def axis_rows(codings: DataFrame, node: list[str], book: Codebook) -> DataFrame:
    """One row per (node, axis) from the first code, in codebook order, whose id begins with the axis and a dot."""
    axes = F.filter(F.array(*map(F.lit, book.axes)), lambda a: F.startswith("code", F.concat(a, F.lit("."))))
    spread = codings.withColumn("axis", F.explode(axes))
    return spread.groupBy(*node, "axis").agg(F.min(F.struct("ord", "confidence", "evidence")).alias("m")).select(*node, "axis", "m.confidence", "m.evidence")


def drill_down(clauses: DataFrame, paragraphs: DataFrame, clause: list[str], paragraph: list[str], span: str, book: Codebook) -> DataFrame:
    """Codes of clauses, put on each paragraph that holds one of the code's terms, or on the clause if none does.

    Conditions hold on the clause alone. Gives (clause, paragraph or null, code, confidence, level, evidence). Paragraphs are
    coded by themselves without conditions, so this is one join on (clause, code) of two small results, never clauses with paragraphs.
    """
    top = coded(clauses, span, book).select(*clause, "code", "confidence", "evidence")
    loose = Codebook(tuple(Code(c.code, c.terms) for c in book.codes))
    inner = coded(paragraphs, span, loose).select(*clause, *paragraph, "code", F.col("evidence").alias("p_evidence"))
    joined = top.join(inner, [*clause, "code"], "left")
    level = F.when(F.col(paragraph[0]).isNull(), "clause").otherwise("paragraph")
    return joined.select(*clause, *paragraph, "code", "confidence", level.alias("level"), F.coalesce("p_evidence", "evidence").alias("evidence"))


def structural_rows(nodes: DataFrame) -> DataFrame:
    """Structural codes: preambles, signature blocks, and one span over all consolidated leaves of a document.

    ``nodes`` has (doc_id, node_id, type, label, char_start, char_end, origin, leaf, ord).
    """
    own = nodes.filter((F.col("type") == "preamble") | (F.col("label") == "SIGNATURES")).select("doc_id", "node_id", "char_start", "char_end", F.when(F.col("type") == "preamble", "Structure/Preamble").otherwise("Structure/Signatures").alias("code"))
    whole = nodes.filter("leaf and origin = 'consolidated'").groupBy("doc_id").agg(F.min_by("node_id", "ord").alias("node_id"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).withColumn("code", F.lit("Structure/Consolidated"))
    return own.unionByName(whole).withColumn("confidence", F.lit(1.0))


def calibrated(metrics: DataFrame, precision: float = AUTO_PRECISION, documents: int = AUTO_DOCUMENTS) -> DataFrame:
    """Codes whose measured precision and number of reference documents allow automatic acceptance; unknown precision doesn't."""
    return metrics.filter((F.col("precision") >= precision) & (F.col("n_reference") >= documents)).select("code")


def triage(annotations: DataFrame, fit: DataFrame, novel: DataFrame | None = None) -> DataFrame:
    """Append ``band``: null for structural codes, CONSOLIDATED for unchanged consolidated clauses, else AUTO or REVIEW.

    ``annotations`` has code, and optionally origin, clause_id (a paragraph's parent or the node itself) and method; rows from a model are never AUTO.
    ``fit`` has the calibrated codes, ``novel`` the clause_ids with something new.
    """
    marked = annotations.join(fit.select("code").distinct().withColumn("__fit", F.lit(True)), "code", "left")
    settled = F.lit(False)
    if "origin" in annotations.columns:
        settled = F.col("origin") == "consolidated"
        if novel is not None:
            marked = marked.join(novel.select("clause_id").distinct().withColumn("__new", F.lit(True)), "clause_id", "left")
            settled = settled & F.col("__new").isNull()
    own = F.coalesce("__fit", F.lit(False))
    if "method" in annotations.columns:
        own = own & (F.col("method") != "model")
    band = F.when(F.startswith("code", F.lit("Structure/")), F.lit(None)).when(F.coalesce(settled, F.lit(False)), "CONSOLIDATED").when(own, "AUTO").otherwise("REVIEW")
    return marked.withColumn("band", band).drop("__fit", "__new")


def uncovered(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Leaf clauses and articles of new text that no annotation covers."""
    wanted = nodes.filter("leaf and origin = 'new' and type in ('clause', 'article')")
    return wanted.join(annotations.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")


def size_batches(rows: DataFrame, key: list[str], order: str, text: str, most: int = BATCH_CHARS) -> DataFrame:
    """Append ``batch`` (from 1 in each key): a batch closes before its text would exceed ``most`` characters; an oversized row is one by itself.

    What a batch holds depends on where the one before closed, so this is a fold over each key's lengths, in order, inside the engine: only
    (order, length) pairs of a key are gathered.
    """
    sized = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("size"), F.expr("cast(array() as array<struct<o:bigint,b:bigint>>)").alias("out"))

    def step(a: Column, r: Column) -> Column:
        new = (a["b"] == 0) | (a["size"] + r["n"] > most)
        b = F.when(new, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(new, r["n"]).otherwise(a["size"] + r["n"]).cast("long").alias("size"), F.array_append(a["out"], F.struct(r["o"].cast("long").alias("o"), b.alias("b"))).alias("out"))

    numbered = sized.select(*key, F.explode(F.aggregate("x", start, step)["out"]).alias("y")).select(*key, F.col("y.o").alias(order), F.col("y.b").alias("batch"))
    return rows.join(numbered, [*key, order])


def digest(book: Codebook, terms: int = 6) -> str:
    """The codebook as a model is told of it: a line per code with its first terms."""
    return "\n".join(f"{c.code} {c.name}: {', '.join(c.terms[:terms])}".strip() for c in book.codes)


def ask(batches: DataFrame, cache: DataFrame, backend: Callable[[str], str]) -> DataFrame:
    """Replies to prompts: (prompt_hash, reply, error). Prompts in the cache aren't sent again.

    ``batches`` has prompt. The cache is anti-joined before any call; ``backend`` runs in the Python workers. A call that fails gives a row with
    the error, never a failed job.
    """
    hashed = batches.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").dropDuplicates(["prompt_hash"])
    new = hashed.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for h, prompt in zip(frame["prompt_hash"], frame["prompt"]):
                try:
                    out.append((h, str(backend(prompt)), None))
                except Exception as error:  # the row says so; other rows go on
                    out.append((h, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["prompt_hash", "reply", "error"])

    asked = new.mapInPandas(call, "prompt_hash string, reply string, error string")
    held = cache.join(hashed.select("prompt_hash"), "prompt_hash", "left_semi").select("prompt_hash", "reply", F.lit(None).cast("string").alias("error"))
    return held.unionByName(asked)


def reply_items(replies: DataFrame, reply: str, codes: tuple[str, ...]) -> DataFrame:
    """Suggestions from replies: (…, idx, label, code, confidence, evidence), for codes of the codebook with a confidence from 0.5 to 1.

    Fields are read as text and cast, so a quoted number counts; evidence is cut at 300 characters. A reply without a list gives nothing.
    """
    schema = "array<struct<idx:string,label:string,code:string,confidence:string,evidence:string>>"
    items = replies.withColumn("__i", F.explode(F.from_json(json_array(reply), schema))).select(*[c for c in replies.columns if c != reply], "__i.*")
    number = lambda c, t: F.expr(f"try_cast(`{c}` as {t})")
    typed = items.withColumn("idx", number("idx", "int")).withColumn("confidence", number("confidence", "double")).withColumn("evidence", F.left(F.coalesce("evidence", F.lit("")), F.lit(300)))
    return typed.filter(F.col("code").isin(*codes) & F.col("confidence").between(0.5, 1.0))


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("__r = 1").drop("__r")
