"""Checks around a run: addresses, files, links, grouped warnings, model benches, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: Names that mean this machine.
LOOPBACK = ("127.0.0.1", "localhost", "::1", "[::1]")


def allowed_url(url, hosts: list[str]) -> Column:
    """An https address of one of the hosts."""
    return F.coalesce((F.parse_url(col(url), F.lit("PROTOCOL")) == "https") & F.lower(F.parse_url(col(url), F.lit("HOST"))).isin(*hosts), F.lit(False))


def local_url(url) -> Column:
    """An http address of this machine, without user or password."""
    host = F.lower(F.parse_url(col(url), F.lit("HOST")))
    return F.coalesce(F.parse_url(col(url), F.lit("PROTOCOL")).isin("http", "https") & host.isin(*LOOPBACK) & F.parse_url(col(url), F.lit("USERINFO")).isNull(), F.lit(False))


def issue_path(year: Column, issue: Column) -> Column:
    """The file of a bulletin issue within a folder."""
    return F.format_string("%d/BTE_%02d_%d.pdf", year.cast("int"), issue.cast("int"), year.cast("int"))


def path_class(path, rules: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The class of a file by the first rule (a prefix or a /part/) that its path meets."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for part, name in rules:
        out = out.when(F.startswith(col(path), F.lit(part)) | F.contains(F.concat(F.lit("/"), col(path)), F.lit(f"/{part.strip('/')}/")), name)
    return out.otherwise(otherwise)


def inventory(files: DataFrame, kind: Column) -> DataFrame:
    """(class, n_files, n_bytes) of files with a path and length."""
    return files.groupBy(kind.alias("class")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def stale(files: DataFrame, days: int, now: Column) -> DataFrame:
    """Files that weren't changed for ``days`` days."""
    return files.filter(F.col("modificationTime") < now - F.expr(f"interval {int(days)} days"))


def broken_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of relative Markdown links to files that aren't there; the case of letters counts.

    ``pages`` has (path, text), ``files`` (path), all relative to one root. ``..`` and ``.`` parts are resolved.
    """
    links = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s#]+)(?:#[^)]*)?\)"), F.lit(1))).alias("target")).filter(~F.col("target").rlike("^[a-z]+:") & (F.col("target") != ""))
    folder = F.regexp_replace("path", "[^/]*$", "")
    parts = F.split(F.concat(folder, F.col("target")), "/")
    empty = F.expr("cast(array() as array<string>)")
    whole = F.aggregate(parts, empty, lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return links.withColumn("__file", F.array_join(whole, "/")).join(files.select(F.col("path").alias("__file")).distinct(), "__file", "left_anti").select("path", "target")


def grouped_warning(rows: DataFrame, text: str, item: str) -> DataFrame:
    """(warning, n, items): one row for each text of a warning, with the items that it concerns in order."""
    return rows.groupBy(F.col(text).alias("warning")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(item)), ", ").alias("items"))


def model_bench(answers: DataFrame) -> DataFrame:
    """(model, hits, false_positives, false_negatives, invalid, mean_latency) of answers (model, expected, got, seconds).

    ``expected`` and ``got`` are codes or null for none; an answer ``!`` couldn't be read.
    """
    e, g = F.col("expected"), F.col("got")
    bad = F.coalesce(g == "!", F.lit(False))
    return answers.groupBy("model").agg(
        F.count_if(~bad & e.eqNullSafe(g)).alias("hits"), F.count_if(~bad & g.isNotNull() & ~e.eqNullSafe(g)).alias("false_positives"), F.count_if(~bad & e.isNotNull() & ~e.eqNullSafe(g)).alias("false_negatives"),
        F.count_if(bad).alias("invalid"), F.avg("seconds").alias("mean_latency"),
    )


def over_budget(measures: DataFrame, budgets: DataFrame) -> DataFrame:
    """Measures (name, value) above an approved budget (name, limit, approved); budgets that aren't approved gate nothing."""
    return measures.join(budgets.filter("approved"), "name").filter(F.col("value") > F.col("limit")).select("name", "value", "limit")


def contract_violations(rows: DataFrame, required: list[str], enums: dict[str, list[str]], least: dict[str, float]) -> DataFrame:
    """Rows that break a contract, with ``problems``: missing or blank required columns, values outside an enum, numbers below a minimum."""
    problems = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"{c} missing")) for c in required]
    problems += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"{c} unknown")) for c, v in enums.items()]
    problems += [F.when(F.col(c) < v, F.lit(f"{c} too small")) for c, v in least.items()]
    return rows.withColumn("problems", F.filter(F.array(*problems), lambda p: p.isNotNull())).filter(F.size("problems") > 0)
