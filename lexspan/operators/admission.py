"""What may enter a run, and what a run is made of: families of file names, admission, subtypes, stored files by content, runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, col
from ..sources.files import doc_id_parts
from .registry import DOWNLOADED, family

# What file names and labels of the sources say.
SHORT_FAMILIES = {"PR": "agreement", "PE": "extension", "AV": "notice", "AA": "accession"}
SUSPECTS = {"PE": "extension?", "PCT": "extension?", "PRT": "extension?", "AA": "accession?"}
WHOLE_ISSUE = r"(?i)^bte\d+_20\d{2}\.pdf$"
LABEL_TYPES = [("PREÂMBULO", "preamble"), ("PREAMBULO", "preamble"), ("Cláusula", "clause"), ("Clausula", "clause"), ("Artigo", "article"), ("Capítulo", "chapter"), ("Secção", "section"), ("Anexo", "annex")]
PROCESSED_FAMILIES, PROCESSED_SCOPES, METADATA_FAMILIES = ("agreement",), ("PRI", "SPE"), ("notice",)
CORRECTION = r"(?i)\bRECT\b|[-–]RECT$|retifica"


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def name_family(name) -> Column:
    """The family that a file name declares in any of its schemes: by its type, or by the short scheme's token; null if it fits none."""
    parts = F.struct(doc_id_parts(col(name))["scheme"].alias("scheme"), doc_id_parts(col(name))["type"].alias("type"))
    return bind(parts, lambda p: F.when(p["scheme"] == "short", lookup(SHORT_FAMILIES, p["type"])).otherwise(family(p["type"])))


def suspected_family(name) -> Column:
    """The likely family of a name outside of the schemes: of its parts the first that is a type of something else than an agreement."""
    return lookup(SUSPECTS, F.try_element_at(F.filter(F.split(col(name), "_"), lambda t: t.isin(*SUSPECTS)), F.lit(1)))


def refused(files: DataFrame, name: str = "name") -> DataFrame:
    """(name, reason) of files that a thematic run must not take: whole issues, and families other than agreements. A run with any of them is refused."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    kind = F.coalesce(name_family(stem), suspected_family(stem))
    reason = F.when(F.col(name).rlike(WHOLE_ISSUE), "whole issue").otherwise(bind(kind, lambda k: F.when(~k.isin(*PROCESSED_FAMILIES), k)))
    return files.select(F.col(name).alias("name"), reason.alias("reason")).filter("reason is not null")


def admitted(files: DataFrame, name: str = "name") -> DataFrame:
    """The files, if all may be processed together; else an error that names some that may not."""
    if some := refused(files, name).orderBy("name").head(3):
        raise ValueError("not single agreements: " + ", ".join(f"{r['name']} ({r['reason']})" for r in some))
    return files


def processable(kind: Column, scope: Column) -> Column:
    """Agreements of private and state-owned employers; a blank scope counts as private."""
    return F.coalesce(kind.isin(*PROCESSED_FAMILIES), F.lit(False)) & F.upper(F.coalesce(F.nullif(scope, F.lit("")), F.lit("PRI"))).isin(*PROCESSED_SCOPES)


def named_entries(entries: DataFrame, families: list[str], confirmed: DataFrame | None = None, metadata: bool = False) -> DataFrame:
    """Registry entries (key, family, state) to be named: of the families, with a stored file, with ``metadata`` False without those that
    are metadata only, and of the confirmed keys if given."""
    out = entries.filter(F.col("family").isin(*families) & F.col("state").isin(*DOWNLOADED))
    out = out if metadata else out.filter(~F.col("family").isin(*METADATA_FAMILIES))
    return out if confirmed is None else out.join(confirmed.select("key").distinct(), "key", "left_semi")


def resolved_subtype(doc_id, variable: Column, registry_type: Column) -> tuple[Column, Column]:
    """(subtype, type): the type of the registry, else of the name; the subtype of the variables, else a correction by its type, else unknown."""
    kind = F.coalesce(F.nullif(registry_type, F.lit("")), doc_id_parts(col(doc_id))["type"], F.lit(""))
    return F.when(F.coalesce(variable, F.lit("")) != "", variable).when(kind.rlike(CORRECTION), "correction").otherwise("unknown"), kind


def label_type(label) -> Column:
    """The node type of a label or of its last path part, by the first prefix that fits; ``block`` for others."""
    label = col(label)
    last = F.trim(F.element_at(F.split(label, r"\\"), -1))
    return F.coalesce(*[F.when(last.startswith(prefix) | label.startswith(prefix), kind) for prefix, kind in LABEL_TYPES], F.lit("block"))


def stored_files(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """Append (path, state) to a manifest of (name, sha256, bytes, url): the first stored file with that content, by an equi-join on size and hash, on the hash
    alone where the size isn't known. ``candidates`` has (path, bytes, sha256)."""
    by = lambda keys, name: candidates.groupBy(*keys).agg(F.min("path").alias(name))
    sized, any_size = by(["bytes", "sha256"], "__p"), by(["sha256"], "__q")
    out = manifest.join(sized, ["bytes", "sha256"], "left").join(any_size, "sha256", "left")
    path = F.coalesce("__p", F.when(F.col("bytes").isNull(), F.col("__q")))
    state = F.when(path.isNotNull(), "copied").when(F.coalesce("url", F.lit("")) == "", "missing: no URL").otherwise("missing: to download")
    return out.withColumn("path", path).withColumn("state", state).drop("__p", "__q")


def urls_by_content(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """The manifest with URLs that the registry (sha256, url, line_no) has for its contents, where it had none; later lines win."""
    known = registry.filter((F.coalesce("sha256", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).groupBy("sha256").agg(F.max_by("url", "line_no").alias("__u"))
    out = manifest.join(known, "sha256", "left")
    return out.withColumn("added", (F.coalesce("url", F.lit("")) == "") & F.col("__u").isNotNull()).withColumn("url", F.coalesce(F.nullif("url", F.lit("")), F.col("__u"))).drop("__u")


def corpus_states(manifest: DataFrame, measured: DataFrame, metrics: list[str]) -> DataFrame:
    """(name, state, error, metrics): every document of a manifest as measured, with its error, or as absent. ``measured`` has (name, error, metrics)."""
    out = manifest.select("name").join(measured.withColumn("__m", F.lit(True)), "name", "left")
    return out.select("name", F.when(F.col("__m").isNull(), "absent").when(F.col("error").isNotNull(), "error").otherwise("measured").alias("state"), "error", *metrics)


def all_annotations(*runs: DataFrame) -> DataFrame:
    """The annotations of several methods as one bag."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def already_complete(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id) whose gold (doc_id, code) pairs are all found already, so that a further method can't add one."""
    pairs = gold.select("doc_id", "code").distinct()
    lacking = pairs.join(found.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti").select("doc_id").distinct()
    return pairs.select("doc_id").distinct().join(lacking, "doc_id", "left_anti")


def gain(without: DataFrame, with_more: DataFrame, gold: DataFrame) -> DataFrame:
    """(code, tp, fp, new_tp, new_fp): what a further method adds to a run, by code. Runs have (doc_id, code, text), gold (doc_id, code, segment)."""
    from .evaluation import pair_states, scores

    a, b = (scores(pair_states(run, gold)).select("code", "tp", "fp") for run in (without, with_more))
    out = b.join(a.select("code", F.col("tp").alias("__t"), F.col("fp").alias("__f")), "code", "left")
    return out.select("code", "tp", "fp", (F.col("tp") - F.coalesce("__t", F.lit(0))).alias("new_tp"), (F.col("fp") - F.coalesce("__f", F.lit(0))).alias("new_fp"))
