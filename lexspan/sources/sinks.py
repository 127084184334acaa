"""Sinks: catalogue and review sheets, registries, manifests, reports, and QDA projects."""

from __future__ import annotations

import uuid
import zipfile
from datetime import datetime, timezone
from pathlib import Path
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_path
from ..operators import lines, lookup

NAMESPACE = "urn:QDA-XML:project:1.0"
#: The root of code identifiers; they follow from a code's path alone.
CODES = uuid.uuid5(uuid.NAMESPACE_URL, "lexspan-codes")


def write_catalogue(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A ; CSV with fixed columns, in order, blank for null."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).orderBy(*order).write.mode("overwrite").option("sep", ";").option("header", "true").option("emptyValue", "").csv(path)


def write_registry(entries: DataFrame, path: str, key: str = "chave") -> None:
    """JSON lines in order of the key; Spark commits all or nothing."""
    entries.drop("line_no").orderBy(key).write.mode("overwrite").json(path)


def append_correspondence(rows: DataFrame, path: str) -> None:
    """Old and new names, added to those already there."""
    rows.select("nome_anterior", "nome_novo").write.mode("append").option("sep", ";").option("header", "true").csv(path)


def upsert_acronyms(held: DataFrame, decisions: DataFrame) -> DataFrame:
    """The acronym table with confirmed decisions (entity, acronym); other rows stay. An empty acronym is refused before anything is written."""
    if not decisions.filter("coalesce(acronym, '') = ''").isEmpty():
        raise ValueError("an acronym is empty")
    return held.alias("a").join(decisions.alias("b"), F.col("a.entity") == F.col("b.entity"), "full_outer").select(F.coalesce("a.entity", "b.entity").alias("entity"), F.coalesce("b.acronym", "a.acronym").alias("acronym"))


def review_rows(annotations: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per annotation for reviewers: code, level, segment (2000 characters at most), clause, context, document, confidence, method, evidence."""
    flat = nodes.withColumn("__id", F.concat_ws("\x1f", "doc_id", "node_id")).withColumn("__up", F.when(F.col("parent_id").isNotNull(), F.concat_ws("\x1f", "doc_id", "parent_id"))).withColumn("__lab", F.when(F.col("type").isin("chapter", "section", "annex"), F.col("label")))
    chains = lookup.parents(flat.select("__id", "__up", "__lab"), "__id", "__up", "__lab").select("__id", F.col("chain").alias("context"))
    own = flat.select("__id", "__up", "doc_id", "node_id", "type", "label")
    up = own.select(F.col("__id").alias("__pid"), F.col("label").alias("__plabel"), F.col("type").alias("__ptype"))
    named = own.join(up, F.col("__up") == F.col("__pid"), "left").select("doc_id", "node_id", "__id", F.when(F.col("type").isin("clause", "article", "preamble", "block"), F.col("label")).when(F.col("__ptype").isin("clause", "article"), F.col("__plabel")).otherwise("").alias("clause"))
    span = F.regexp_replace(F.substr("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")), r"(?U)^\s+|\s+$", "")
    out = annotations.join(named, ["doc_id", "node_id"]).join(chains, "__id").join(texts.select("doc_id", "text"), "doc_id")
    return out.select("code", "level", F.left(span, F.lit(2000)).alias("segment"), "clause", "context", "doc_id", "confidence", "method", "evidence")


def diff_rows(diffs: DataFrame) -> DataFrame:
    """Version differences for reviewers: new first, then altered, removed and equal clauses, by label."""
    rank = F.when(F.col("class") == "nova", 0).when(F.col("class") == "alteracao", 1).when(F.col("class") == "removida", 2).otherwise(3)
    return diffs.select("class", F.coalesce("new_label", F.lit("")).alias("new_label"), F.coalesce("old_label", F.lit("")).alias("old_label"), "similarity", F.when(F.col("renumbered"), "sim").otherwise("").alias("renumbered"), F.left("diff", F.lit(8000)).alias("diff")).orderBy(rank, "new_label")


def manifest(files: DataFrame, role: str) -> DataFrame:
    """(role, path, size_bytes, sha256) of binary files."""
    return files.select(F.lit(role).alias("role"), "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, altered or extra against a manifest (path, sha256)."""
    both = listed.select("path", F.col("sha256").alias("a")).join(present.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return both.withColumn("state", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "altered")).filter("state is not null").select("path", "state")


def metrics_report(by_code: DataFrame, total: DataFrame) -> str:
    """Metrics as a fixed-width table. One row per code of the codebook comes to the driver."""
    show = lambda v: "--" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    head = f"{'code':<12} {'n_ref':>5} {'TP':>4} {'FP':>4} {'FN':>4} {'TPseg':>5} {'prec':>6} {'rec':>6} {'F1':>6}"
    body = [f"{r['code']:<12} {r['n_reference']:>5} {r['tp']:>4} {r['fp']:>4} {r['fn']:>4} {r['tp_segment']:>5} {show(r['precision']):>6} {show(r['recall']):>6} {show(r['f1']):>6}" for r in by_code.orderBy("code").collect()]
    g = total.first()
    return "\n".join([head, *body, f"{'GLOBAL':<12} {'':>5} {g['tp']:>4} {g['fp']:>4} {g['fn']:>4} {g['tp_segment']:>5} {show(g['precision']):>6} {show(g['recall']):>6}"])


def diagnosis(measures: DataFrame, missing: DataFrame, title: str = "Diagnosis") -> str:
    """A Markdown report: how many documents have each verdict, the worst by coverage, and the words most often missing over all documents."""
    count = {r["verdict"]: r["n"] for r in measures.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    worst = measures.orderBy("coverage", "doc_id").limit(20).collect()
    words = missing.groupBy("word").agg(F.sum("missing").alias("n")).orderBy(F.desc("n"), "word").limit(25).collect()
    rows = [f"# {title}", "", *[f"- {k}: {v}" for k, v in sorted(count.items())], "", "| document | verdict | coverage | excess |", "|-|-|-|-|"]
    rows += [f"| {r['doc_id']} | {r['verdict']} | {r['coverage']:.4f} | {r['excess']:.4f} |" for r in worst]
    return "\n".join([*rows, "", "Missing: " + ", ".join(f"{r['word']} ({r['n']})" for r in words)])


def code_guid(path: list[str]) -> str:
    return str(uuid.uuid5(CODES, "/".join(path)))


def write_project(docs: DataFrame, annotations: DataFrame, points: DataFrame | None, path: str, name: str = "project") -> str:
    """A QDA project file: the tree of codes, and for each document its text, spaced at ``points``, with a selection per annotation.

    The format is one archive, so documents stream through the driver one at a time, in order of doc_id. Positions count code points of the spaced text.
    Code identifiers follow from the code's path; those of selections from document and place, so a rerun gives the same file but for its time.
    """
    ET.register_namespace("", NAMESPACE)
    tag = lambda t: f"{{{NAMESPACE}}}{t}"
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    project = ET.Element(tag("Project"), {"name": name, "creationDateTime": now})
    user = code_guid(["user"])
    ET.SubElement(ET.SubElement(project, tag("Users")), tag("User"), {"guid": user, "name": name})
    tree = ET.SubElement(ET.SubElement(project, tag("CodeBook")), tag("Codes"))
    made: dict[tuple, ET.Element] = {(): tree}
    target: dict[str, str] = {}
    for r in annotations.select("code").distinct().select("code", code_path("code").alias("path")).orderBy("code").collect():
        for k in range(1, len(r["path"]) + 1):
            at = tuple(r["path"][:k])
            if at not in made:
                made[at] = ET.SubElement(made[at[:-1]], tag("Code"), {"guid": code_guid(list(at)), "name": at[-1], "isCodable": "true"})
        target[r["code"]] = code_guid(r["path"])
    text = lines.spaced(docs.select("doc_id", "text"), points, ["doc_id"]) if points is not None else docs.select("doc_id", "text", F.col("text").alias("spaced"))
    spans = annotations if points is None else lines.remap(annotations, points, ["doc_id"]).withColumn("char_start", F.col("new_start")).withColumn("char_end", F.col("new_end"))
    held = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "code", "confidence", "method", F.coalesce("evidence", F.lit("")).alias("evidence")))).alias("x"))
    sources = ET.SubElement(project, tag("Sources"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in text.join(held, "doc_id", "left").select("doc_id", "spaced", "x").orderBy("doc_id").toLocalIterator():
            guid = code_guid(["source", str(r["doc_id"])])
            source = ET.SubElement(sources, tag("TextSource"), {"guid": guid, "name": str(r["doc_id"]), "plainTextPath": f"internal://{guid}.txt", "creatingUser": user})
            for k, a in enumerate(r["x"] or []):
                mark = ET.SubElement(source, tag("PlainTextSelection"), {"guid": code_guid([guid, str(k)]), "startPosition": str(a["char_start"]), "endPosition": str(a["char_end"])})
                ET.SubElement(mark, tag("Description")).text = f"method={a['method']}; confidence={a['confidence']:.2f}; evidence={a['evidence']}"
                ET.SubElement(ET.SubElement(mark, tag("Coding"), {"guid": code_guid([guid, str(k), "c"])}), tag("CodeRef"), {"targetGUID": target[a["code"]]})
            z.writestr(f"Sources/{guid}.txt", r["spaced"].replace("\r\n", "\n").encode())
        z.writestr("project.qde", ET.tostring(project, encoding="utf-8", xml_declaration=True))
    return path


def run_folder(base: str, name: str) -> Path:
    """A new folder for a run: the plain name, or with a time if earlier runs are there."""
    first = Path(base) / name
    if not first.exists():
        first.mkdir(parents=True)
        return first
    later = Path(base) / f"{name}_{datetime.now().strftime('%Y%m%d-%H%M%S-%f')}"
    later.mkdir(parents=True)
    return later


def write_documents(rows: DataFrame, path: str) -> None:
    """A folder of JSON per document."""
    rows.write.mode("overwrite").partitionBy("doc_id").json(path)
