"""Warnings about extracted documents: clauses without a body, what follows the deposit note, annexes without their table, leftovers.

All are expressions over nodes (doc_id, node_id, type, label, char_start, char_end, parent_id, leaf, span) or over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, words
from .lookup import descendants

# Forms that the documents use.
CLOSED = r"(?:[.!?]|\d\.?\s?[ªº])[\s)\]»”\"']*$"
ANNOUNCES = r"(?i)(reda[çc][ãa]o|termos seguintes|forma seguinte|seguinte teor|aditad[oa]s?|republicad[oa]s?)\b[^:]*:$"
NO_SENTENCES = r" \| |\(\s*(?:\.\s*){3}\)|\(\s*…\s*\)|\[\s*(?:\.\s*){3}\]|[=×]"
DEPOSIT = r"(?i)\bDepositad[oa]\s+(?:em|a)\s+\d"
CORRECTION = r"(?i)\bRECT\b|[-–]RECT$|retifica"
CORRECTION_TITLE = r"(?i)\s[-–—]\s*re(?:c)?tifica[çc][ãa]o\b"
SALARY_TITLE = r"(?i)\s[-–—]\s*altera[çc][ãa]o\s+salarial\b"
HEADING_FORM = r"^(?:Cl[aá]usula|CL[AÁ]USULA|Artigo|ARTIGO)\s"
STRUCTURAL = r"^(?:Cl[aá]usula|CL[AÁ]USULA|Artigo|ARTIGO|CAP[IÍ]TULO|T[IÍ]TULO)\b"
TABLE_ANNEX = r"(?i)remunera|sal[áa]ri|venciment|mapa|escal[ãa]o|carreir|n[íi]vel"
VALUE_ANNEX = r"(?i)tabela|remunera|sal[áa]ri|venciment|retribui"
AMOUNT = r"\d(?:[\d .]*\d)?,\d{2}\b"
LEVEL = r"\b(?:N[íi]vel|Grupo|Grau|Escal[ãa]o)\s+(?:[IVXLCD]+|\d+)\b"
FRAMEWORK = r"(?i)enquadramento|categori|profiss"
HEADER, DATED, FOOTER = r"(?i)^Boletim do Trabalho e Emprego,?\s*(?:n\.?\s*º\s*)?\d+(?:,\s*\d{1,2}/\d{1,2}/\d{4})?$", r"(?i)^\d{1,2}\s+(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+\d{4}$", r"^BTE(?:\s+\d+(?:\s*\|\s*\d+)?|\s*\|\s*\d+)$"
PAGE_NUMBER, SPLIT_FOOTER = r"^\d{1,4}$", r"^(?:BTE\s*)?\d{0,3}\s*\|\s*\d{1,4}$"
GLUED = r"Boletim do Trabalho e Emprego \d+(?![\d,])|\bBTE \d+ \| \d+\b"
HEADER_PREFIX = r"(?i)^Boletim do Trabalho e Emprego\s+\d+(?:\s+\d{1,2}\s+(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+\d(?:\s?\d){3})?(?=\s|$)\s*"
DATED_HEADER = r"(?i)\s*Boletim do Trabalho e Emprego\s+\d+\s+\d{1,2}\s+(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+\d(?:\s?\d){3}(?!\d)"


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_furniture(line) -> Column:
    """A whole line of page furniture: header, date or footer."""
    s = strip(line)
    return s.rlike(HEADER) | s.rlike(DATED) | s.rlike(FOOTER)


def margin_furniture(line) -> Column:
    """Furniture in a page's margin only: page numbers and split footers."""
    s = strip(line)
    return s.rlike(PAGE_NUMBER) | s.rlike(SPLIT_FOOTER)


def without_header_prefix(line) -> Column:
    return F.regexp_replace(strip(line), HEADER_PREFIX, "")


def without_dated_header(line) -> Column:
    """The line without a dated header wherever it stands."""
    return F.when(col(line).rlike(DATED_HEADER), strip(F.regexp_replace(col(line), DATED_HEADER, " "))).otherwise(col(line))


def has_residue(line) -> Column:
    return is_furniture(line) | col(line).rlike(GLUED)


def clean_page(rows: DataFrame, page: list[str], margin: int = 2) -> DataFrame:
    """Lines of a page as its reference reading should have them: furniture gone, header prefixes cut; (…, line, removed)."""
    full = F.when(strip("line") != "", F.col("line_no"))
    up, down = Window.partitionBy(*page, "__blank").orderBy("line_no"), Window.partitionBy(*page, "__blank").orderBy(F.desc("line_no"))
    ranked = rows.withColumn("__blank", full.isNull()).withColumn("__u", F.row_number().over(up)).withColumn("__d", F.row_number().over(down))
    edge = ~F.col("__blank") & ((F.col("__u") <= margin) | (F.col("__d") <= margin))
    out = ranked.withColumn("removed", is_furniture("line") | (edge & margin_furniture("line"))).withColumn("line", F.when(F.col("line").rlike(HEADER_PREFIX) | F.col("line").rlike(DATED_HEADER), without_dated_header(without_header_prefix("line"))).otherwise(F.col("line")))
    return out.drop("__blank", "__u", "__d")


def long_lines(rows: DataFrame, key: list[str], longest: int = 600) -> DataFrame:
    """Lines that look like a collapsed table: long, with cells or mostly numbers, and not a row like its neighbours."""
    w = Window.partitionBy(*key).orderBy("line_no")
    cells = lambda c: F.size(F.split(c, r" \| "))
    numeric = lambda c: (F.size(F.filter(F.split(strip(c), r"\s+"), lambda t: t.rlike(r"\d"))) > 0.4 * F.size(F.split(strip(c), r"\s+")))
    near = rows.withColumn("__p", F.lag("line").over(w)).withColumn("__n", F.lead("line").over(w))
    long = near.filter(F.length("line") > longest)
    celled = F.contains("line", F.lit(" | "))
    twin = lambda c: F.coalesce(F.contains(F.col(c), F.lit(" | ")) & (cells(F.col(c)) == cells(F.col("line"))), F.lit(False))
    short = F.array_join(F.filter(F.split("line", r" \| "), lambda c: (F.size(F.split(strip(c), r"\s+")) < 10) | numeric(c)), " | ")
    whole = celled & (twin("__p") | twin("__n") | (F.length(short) <= longest))
    return long.filter((celled | numeric(F.col("line"))) & ~whole).select(*key, "line_no", F.length("line").alias("n_chars"))


def body(span) -> Column:
    """A node's text without its first line, trimmed."""
    return strip(F.regexp_replace(col(span), r"^[^\n]*\n?", ""))


def clauses_without_body(nodes: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, problem): leaf clauses and articles that are empty or hold no closed sentence.

    Exempt: an article that announces the clauses it is followed by, a body of tables, formulas or omitted text, and a body that ends in a colon
    where the reference words (doc_id, words) pass straight on to the next heading.
    """
    wanted = nodes.filter("leaf and type in ('clause', 'article')").withColumn("__body", body("span"))
    nxt = nodes.filter("type in ('clause', 'article', 'annex', 'chapter', 'section')").select("doc_id", F.col("char_start").alias("char_end"), F.col("type").alias("__next"), F.col("label").alias("__label")).dropDuplicates(["doc_id", "char_end"])
    joined = wanted.join(nxt, ["doc_id", "char_end"], "left")
    lines = F.filter(F.split("__body", "\n"), lambda x: strip(x) != "")
    closed = F.exists(lines, lambda x: x.rlike(CLOSED))
    announces = (F.col("type") == "article") & (F.col("__next") == "clause") & strip(F.element_at(F.split("__body", "\n"), -1)).rlike(ANNOUNCES)
    as_printed = F.lit(False)
    if reference is not None:
        joined = joined.join(reference.select("doc_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("__ref")), "doc_id", "left")
        tail, head = F.reverse(F.slice(F.reverse(words("__body")), 1, 6)), F.slice(words("__label"), 1, 3)
        as_printed = F.endswith("__body", F.lit(":")) & (F.size(head) > 0) & F.contains("__ref", F.concat(F.lit(" "), F.array_join(F.concat(tail, head), " "), F.lit(" ")))
    no = F.lit(False)
    problem = F.when(F.col("__body") == "", "empty").when(~closed & ~F.coalesce(announces, no) & ~F.col("span").rlike(NO_SENTENCES) & ~F.coalesce(as_printed, no), "no closed sentence")
    return joined.select("doc_id", "node_id", "label", problem.alias("problem")).filter("problem is not null")


def title_lines(text, most: int = 8) -> Column:
    """Non-blank lines before the first structural heading, eight at most."""
    rows = F.filter(F.transform(F.split(col(text), "\n"), lambda x: strip(x)), lambda x: x != "")
    return F.aggregate(rows, F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(False).alias("stop")), lambda a, x: F.when(a["stop"] | x.rlike(STRUCTURAL) | (F.size(a["out"]) >= most), F.struct(a["out"].alias("out"), F.lit(True).alias("stop"))).otherwise(F.struct(F.array_append(a["out"], x).alias("out"), F.lit(False).alias("stop"))))["out"]


def is_correction(text, subtype=None, registry_type=None) -> Column:
    """A document that corrects another: by subtype, registry type, or title."""
    out = F.exists(title_lines(text), lambda x: x.rlike(CORRECTION_TITLE))
    for c in (subtype, registry_type):
        if c is not None:
            out = out | F.coalesce(col(c), F.lit("")).rlike(CORRECTION)
    return out


def deposit_problem(text, correction: Column) -> Column:
    """Null if the deposit note closes the document (it may go on for two lines until a sentence closes), else what is wrong."""
    rows = F.filter(F.transform(F.split(col(text), "\n"), lambda x: strip(x)), lambda x: x != "")
    at = F.array_position(F.transform(rows, lambda x: x.rlike(DEPOSIT)), F.lit(True)).cast("int")
    closed = lambda i: F.coalesce(F.get(rows, i - 1).rlike(CLOSED), F.lit(True))
    end = F.when(closed(at), at).when(closed(at + 1), at + 1).otherwise(at + 2)
    after = F.size(rows) - F.least(end, F.size(rows))
    return F.when(F.size(rows) == 0, "empty document").when(correction, F.lit(None)).when(at == 0, "no deposit note").when(after > 0, F.concat(after.cast("string"), F.lit(" line(s) after the deposit note")))


def no_articles(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, reason) of documents without clause or article: a correction, a salary change of numbers alone, or unrecognised structure."""
    some = nodes.filter("type in ('clause', 'article')").select("doc_id").distinct()
    rows = F.split(text, "\n")
    salary = F.exists(title_lines(text), lambda x: x.rlike(SALARY_TITLE)) & ~F.exists(rows, lambda x: x.rlike(HEADING_FORM) & ~F.contains(x, F.lit(" | ")))
    reason = F.when(is_correction(text), "correction").when(salary, "salary change").otherwise("no structure")
    return docs.join(some, "doc_id", "left_anti").select("doc_id", reason.alias("reason"))


def missing_tables(nodes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, label, problem): annexes whose label promises a table and that hold none.

    An annex is its heading and all below it. It is excused by three amounts, by a framework of levels read as text, or by being a text whose
    label promises no values. ``images`` (doc_id, pages) explains a table that is a picture.
    """
    keyed = nodes.withColumn("__id", F.concat_ws("\x1f", "doc_id", "node_id")).withColumn("__up", F.when(F.col("parent_id").isNotNull(), F.concat_ws("\x1f", "doc_id", "parent_id")))
    annexes = keyed.filter((F.col("type") == "annex") & F.col("label").rlike(TABLE_ANNEX))
    below = descendants(keyed.filter("leaf"), "__id", "__up", annexes.select("__id")).join(keyed.select(F.col("__id").alias("node"), "char_start", "span"), "node")
    own = annexes.select(F.col("__id").alias("root"), "char_start", "span")
    whole = below.select("root", "char_start", "span").unionByName(own).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("char_start", "span"))).alias("x")).select(F.col("root").alias("__id"), F.array_join(F.transform("x", lambda s: s["span"]), "").alias("__raw"))
    tables = nodes.groupBy("doc_id").agg(F.max(F.contains("span", F.lit(" | ")).cast("int")).alias("__any"))
    found = annexes.join(whole, "__id").join(tables, "doc_id").filter(~F.contains("__raw", F.lit(" | ")))
    rest = F.regexp_replace("__raw", r"^[^\n]*\n?", "")
    levels = F.regexp_count(rest, F.lit(LEVEL))
    told = F.size(F.filter(F.slice(F.split(rest, LEVEL), 2, 100000), lambda x: x.rlike("[A-Za-zÀ-ÿ]{3,}")))
    left_out = F.size(F.filter(F.slice(F.split(rest, LEVEL), 2, 100000), lambda x: strip(x).rlike(r"^[(\[]\s*(?:(?:\.\s*){3}|…)\s*[)\]]\.?$")))
    framework = F.col("label").rlike(FRAMEWORK) & (levels >= 3) & (told >= 3) & (told * 2 > levels - left_out)
    prose = (F.size(F.filter(F.split(rest, "\n"), lambda x: strip(x) != "")) >= 3) & ~F.col("label").rlike(VALUE_ANNEX)
    found = found.filter(~((F.regexp_count("__raw", F.lit(AMOUNT)) >= 3) | framework | prose))
    problem = F.when(F.col("__any") == 1, "table outside the annex").otherwise("no table in the document")
    if images is not None:
        found = found.join(images.select("doc_id", F.col("pages").alias("__pages")), "doc_id", "left")
        problem = F.when(F.size("__pages") > 0, F.concat(F.lit("table is an image on "), F.array_join("__pages", ", "))).otherwise(problem)
    return found.select("doc_id", "node_id", "label", problem.alias("problem"))


def extractor_disagreement(by_a: Column, in_text: Column, by_b: Column | None = None) -> Column:
    """Warnings where one extractor sees tables and the text or the other has none."""
    out = [F.when((by_a > 0) & (in_text == 0), "first extractor sees tables, the text has none")]
    if by_b is not None:
        out += [F.when((by_b > 0) & (in_text == 0), "second extractor sees tables, the text has none"), F.when((by_b == 0) & (by_a > 0), "tables that the second extractor doesn't see")]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def first_warnings(warnings: Column, most: int = 5) -> Column:
    """The first warnings, and an ellipsis if there are more."""
    return F.when(F.size(warnings) > most, F.concat(F.slice(warnings, 1, most), F.array(F.lit("…")))).otherwise(warnings)


#: Rules of the secret scan. Fixed forms of public credential formats.
SECRETS = {"private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "aws key": r"\bAKIA[0-9A-Z]{16}\b", "github token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "assigned secret": r"(?i)\b(?:api[_-]?key|secret|token|password)\s*[=:]\s*['\"]?[A-Za-z0-9_\-]{16,}"}


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, rule, n): credentials found by rule."""
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(text, F.lit(p)).alias("n")) for k, p in SECRETS.items()]), lambda x: x["n"] > 0)
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.rule", "x.n")
