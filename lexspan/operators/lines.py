"""Documents as ordered lines; segments with exact offsets; page furniture, paragraphs, tables, spacing.

All offsets are half-open code-point positions in the document's text. Every window is partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

#: A numbered or lettered item or a dash opens a paragraph.
PARAGRAPH = r"^(?:\d+\s*[-–—.)]|[a-z]\)|[ivxl]+\)|[-–—•§]\s?)"
CELL = " | "
COLUMN_MARK = "\x01"


def lines(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no from 1, line, char_start, char_end): the lines of each text tile it, newline included.

    ``key`` identifies a document. Offsets are a running sum of line lengths within the document. Null texts give no line.
    """
    rows = docs.select(*key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("__i", "line"), F.length(text).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))
    return placed.select(*key, (F.col("__i") + 1).alias("line_no"), "line", "char_start", F.least(F.col("char_start") + F.length("line") + 1, F.col("__n")).cast("int").alias("char_end"))


def segments(rows: DataFrame, key: list[str], opens: Column) -> DataFrame:
    """Group lines into segments: a line where ``opens`` holds begins one; the first segment holds what comes before.

    Gives (key, ord from 0, label, n_lines, char_start, char_end): contiguous, so nothing of the text is lost.
    """
    w = Window.partitionBy(*key).orderBy("line_no")
    numbered = rows.withColumn("ord", F.sum(F.when(opens, 1).otherwise(0)).over(w)).withColumn("__o", opens)
    return numbered.groupBy(*key, "ord").agg(F.min_by(F.when(F.col("__o"), F.col("line")).otherwise(""), "line_no").alias("label"), F.count("*").alias("n_lines"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def running_bounds(rows: DataFrame, key: list[str], marker: Column) -> DataFrame:
    """(key, seq from 1, label, char_start, char_end) of the pieces that marker lines open within each key; what precedes the first isn't one."""
    cut = segments(rows, key, marker).filter("ord > 0")
    return cut.select(*key, F.col("ord").alias("seq"), F.left(F.trim("label"), F.lit(60)).alias("label"), "char_start", "char_end")


def table_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Runs of two or more neighbouring lines with cells: (key, block from 1, first_line, n_lines)."""
    w = Window.partitionBy(*key).orderBy("line_no")
    flagged = rows.withColumn("__c", F.contains("line", F.lit(CELL)))
    edges = flagged.withColumn("__new", F.when(F.col("__c") & ~F.coalesce(F.lag("__c").over(w), F.lit(False)), 1).otherwise(0))
    runs = edges.withColumn("__run", F.sum("__new").over(w)).filter("__c").groupBy(*key, "__run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines")).filter("n_lines >= 2")
    return runs.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("first_line")).alias("block"), "first_line", "n_lines")


def spacing_points(rows: DataFrame, key: list[str], heading: Column) -> DataFrame:
    """(key, point): where an export puts an empty line: at headings, and where table blocks begin or end; never at 0."""
    w = Window.partitionBy(*key).orderBy("line_no")
    cell = F.contains("line", F.lit(CELL))
    flagged = rows.withColumn("__c", cell).withColumn("__b", F.lag("__c").over(w))
    edge = F.col("__b").isNotNull() & (F.col("__b") != F.col("__c"))
    return flagged.filter((heading | edge) & (F.col("char_start") > 0)).select(*key, F.col("char_start").alias("point")).distinct()


def remap(spans: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Positions after a newline is put in at every point: starts move for points <= start, ends for points < end.

    Points are gathered per document (they are at most its lines) and counted in the row: one equi-join, no range join.
    """
    held = points.groupBy(*key).agg(F.array_sort(F.collect_set("point")).alias("__pts"))
    joined = spans.join(held, key, "left").withColumn("__pts", F.coalesce("__pts", F.expr("cast(array() as array<int>)")))
    start = F.col("char_start") + F.size(F.filter("__pts", lambda p: p <= F.col("char_start")))
    end = F.col("char_end") + F.size(F.filter("__pts", lambda p: p < F.col("char_end")))
    return joined.withColumn("new_start", start).withColumn("new_end", end).drop("__pts")


def inserted_positions(points: DataFrame, key: list[str]) -> DataFrame:
    """Where the newlines lie in the spaced text: the k-th point (from 0) moved by k."""
    return points.withColumn("position", F.col("point") + F.row_number().over(Window.partitionBy(*key).orderBy("point")) - 1)


def spaced(docs: DataFrame, points: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The text with a newline at each point."""
    held = points.groupBy(*key).agg(F.array_sort(F.collect_set("point")).alias("__pts"))
    joined = docs.join(held, key, "left").withColumn("__pts", F.coalesce("__pts", F.expr("cast(array() as array<int>)")))
    cuts = F.concat(F.array(F.lit(0)), F.col("__pts"), F.array(F.length(text)))
    pieces = F.transform(F.sequence(F.lit(1), F.size("__pts") + 1), lambda i: F.substr(F.col(text), F.element_at(cuts, i) + 1, F.element_at(cuts, i + 1) - F.element_at(cuts, i)))
    return joined.withColumn("spaced", F.array_join(pieces, "\n")).drop("__pts")


def margins(rows: DataFrame, page: list[str]) -> DataFrame:
    """Mark the margin lines of each page: the first and last max(1, min(3, n / 4)) of its n non-blank lines, tables excepted."""
    blank = F.trim("line") == ""
    up, down = Window.partitionBy(*page, "__blank").orderBy("line_no"), Window.partitionBy(*page, "__blank").orderBy(F.desc("line_no"))
    ranked = rows.withColumn("__blank", blank).withColumn("__up", F.row_number().over(up)).withColumn("__down", F.row_number().over(down)).withColumn("__n", F.count("*").over(Window.partitionBy(*page, "__blank")))
    size = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("__n") / 4)))
    inside = ~F.col("__blank") & ((F.col("__up") <= size) | (F.col("__down") <= size)) & ~F.contains("line", F.lit(CELL))
    return ranked.withColumn("in_margin", inside).drop("__blank", "__up", "__down", "__n")


def furniture(rows: DataFrame, doc: list[str], page: list[str], threshold: Column | None = None) -> DataFrame:
    """Lines that repeat in the margins of a document's pages: (doc, line, n_pages) with n_pages at the threshold or more.

    The threshold is max(3, half the document's pages, rounded up) unless given; a line counts once per page. Counts of pages
    and of line occurrences are two pre-aggregated shuffles; no page is gathered.
    """
    marked = margins(rows, page)
    pages = marked.select(*page).distinct().groupBy(*doc).agg(F.count("*").alias("__pages"))
    repeated = marked.filter("in_margin").select(*page, F.trim("line").alias("line")).distinct().groupBy(*doc, "line").agg(F.count("*").alias("n_pages"))
    limit = threshold if threshold is not None else F.greatest(F.lit(3), F.ceil(F.col("__pages") / 2))
    return repeated.join(pages, doc).filter(F.col("n_pages") >= limit).drop("__pages")


def without_furniture(rows: DataFrame, doc: list[str], page: list[str], threshold: Column | None = None) -> DataFrame:
    """The lines that stay once repeated margin lines are gone."""
    marked = margins(rows, page).withColumn("__line", F.trim("line"))
    gone = furniture(rows, doc, page, threshold).select(*doc, F.col("line").alias("__line"), F.lit(True).alias("__gone"))
    return marked.join(gone, [*doc, "__line"], "left").filter(~(F.col("in_margin") & F.coalesce("__gone", F.lit(False)))).drop("__line", "__gone", "in_margin")


def tagged_text(raw: DataFrame, file: str = "file") -> DataFrame:
    """Documents and nodes of tagged text (#TEXT id / #CODE label / body / #ENDCODE): (file, doc_no, doc_id, node_no, label, text, char_start, char_end).

    A node's text is its body without newlines at the ends, and one newline; nodes of a document tile its text.
    """
    w = Window.partitionBy(file).orderBy("line_no")
    tag = lambda t: F.startswith("line", F.lit(t))
    at = raw.withColumn("doc_no", F.sum(F.when(tag("#TEXT"), 1).otherwise(0)).over(w)).withColumn("node_no", F.sum(F.when(tag("#CODE"), 1).otherwise(0)).over(w)).withColumn("__ends", F.sum(F.when(tag("#ENDCODE"), 1).otherwise(0)).over(w))
    ids = at.filter(tag("#TEXT")).select(file, "doc_no", F.trim(F.substr("line", F.lit(6))).alias("doc_id"))
    labels = at.filter(tag("#CODE")).select(file, "node_no", F.trim(F.element_at(F.split(F.substr("line", F.lit(6)), r"\\"), -1)).alias("label"))
    body = at.filter(~tag("#") & (F.col("node_no") > F.col("__ends"))).groupBy(file, "doc_no", "node_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    nodes = body.select(file, "doc_no", "node_no", F.concat(F.regexp_replace(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), r"^\n+|\n+$", ""), F.lit("\n")).alias("text"))
    order = Window.partitionBy(file, "doc_no").orderBy("node_no")
    nodes = nodes.withColumn("char_end", F.sum(F.length("text")).over(order)).withColumn("char_start", F.col("char_end") - F.length("text"))
    return nodes.join(ids, [file, "doc_no"]).join(labels, [file, "node_no"]).select(file, "doc_no", "doc_id", "node_no", "label", "text", "char_start", "char_end")


def forward_fill(rows: DataFrame, key: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def number_jumps(rows: DataFrame, key: list[str], order: list[str], number: str) -> DataFrame:
    """How often a number isn't the one before plus 1: (key, jumps)."""
    before = F.lag(number).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__j", F.when(before.isNotNull() & (F.col(number) != before + 1), 1).otherwise(0)).groupBy(*key).agg(F.sum("__j").alias("jumps"))


def column_segments(rows: DataFrame, page: list[str], mark: str = COLUMN_MARK) -> DataFrame:
    """Number a page's columns: lines equal to the mark separate them and go."""
    w = Window.partitionBy(*page).orderBy("line_no")
    return rows.withColumn("segment_no", F.sum(F.when(F.col("line") == mark, 1).otherwise(0)).over(w)).filter(F.col("line") != mark)


def join_hyphens(c) -> Column:
    """Extracted text cleaned: words split at a line's end joined, blanks at line ends off, at most one empty line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), r"-\n(?=[a-zà-ÿ])", ""), r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")


def table_row(cells) -> Column:
    """Cells of a row as ``a | b``: words split at a line's end joined, other breaks to spaces."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"-\s*\n\s*(?=[a-zà-ú])", ""), r"[ \t]*\n[ \t]*", " "))
    return F.array_join(F.transform(col(cells), clean), CELL)
