"""Sources: index sheets, registries, vocabularies, codebooks, reference samples, folders of documents.

Files are read by Spark's own readers, so any store that Spark reads will do. Sheets come as XLSX (read with the standard library) or CSV.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed, entity_key, strip_accents

#: Internal name -> normalised headers of an index sheet, in both dialects. Fixed values.
HEADERS = {
    "year": ["ano"], "id": ["id", "iddocumento"], "title": ["titulododocumento", "titulo"], "type": ["tipodedocumento", "tiposubtipodoc"],
    "volume": ["nvolumedoboletim", "novolumedoboletim", "nvolumebte"], "issue_no": ["ndoboletim", "nodoboletim", "nbte"], "issue_date": ["datadoboletim", "databte"],
    "delivery_date": ["datadedistribuicaodoboletim", "datadistribuicaobte"], "page": ["paginanaversaoescrita", "pagversaoescrita"], "cae": ["cae"], "code": ["codirct", "codigogepdgert"],
    "sectors": ["sectoresdeactividade", "setoresdeatividade", "setoresatividade", "sectoresatividade"], "signatories": ["outorgantes", "outorgantes1"],
    "alters": ["docsalteradosporeste", "docalteradosporeste", "docsalteradosporeste2", "docalteradosporeste2"],
    "altered_by": ["docsquealteramestes", "docsquealteramestee", "docsquealterameste", "docalterameste", "docsalteramestes"],
    "in_force": ["documentosemvigor", "docsemvigor"], "url_in_force": ["linkdocemvigor", "linkparaodocumentoemvigor"], "url": ["linkparaodocumentocriado", "linkparaodocumento", "urlpdf"],
    "file": ["paginacriado", "nomepdf"],
}
#: Fields whose repeated columns are parts of one value.
JOINED = ("alters", "altered_by")


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of an XLSX file: shared and inline strings, numbers as written, blanks as None."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            path = targets[sheet.get(rel)].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            for k, row in enumerate(ET.fromstring(z.read(path)).iter(f"{main}row"), 1):
                cells: list[str | None] = []
                for c in row.iter(f"{main}c"):
                    letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                    at = len(cells) if letters is None else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1
                    cells += [None] * (at - len(cells))
                    value = c.find(f"{main}v")
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                    cells.append(text)
                yield sheet.get("name", ""), int(row.get("r", k)), cells


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, cells) of XLSX files below a path; a file that can't be read gives a row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            out = []
            for file, data in zip(frame["path"], frame["content"]):
                try:
                    out += [(file, s, n, cells, None) for s, n, cells in sheet_rows(bytes(data))]
                except Exception as error:
                    out.append((file, None, 0, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["file", "sheet", "row_no", "cells", "error"])

    return files.mapInPandas(run, "file string, sheet string, row_no int, cells array<string>, error string")


def header_columns(header: list[str | None]) -> dict[str, list[int]]:
    """Where each internal field's columns are; a header may be repeated."""
    import unicodedata

    plain = ["".join(c for c in unicodedata.normalize("NFD", str(h or "")) if unicodedata.category(c) != "Mn") for h in header]
    keys = ["".join(c for c in h.lower() if c.isalnum()) for h in plain]
    return {name: [i for i, k in enumerate(keys) if k in known] for name, known in HEADERS.items()}


def index_rows(sheets: DataFrame) -> DataFrame:
    """Index rows of sheets: columns of HEADERS as text, with (file_name, sheet, position). Sheets without a title or URL column are skipped, as are
    rows with neither. Scalar fields take their first filled column, joined ones all distinct values.

    Headers are few (one row per sheet) and come to the driver; rows are projected by their sheet's header.
    """
    good = sheets.filter("error is null")
    heads = good.filter("row_no = 1").select("file", "sheet", "cells").collect()
    out = None
    for h in heads:
        where = header_columns(h["cells"])
        if not where["title"] and not where["url"]:
            continue
        rows = good.filter((F.col("file") == h["file"]) & (F.col("sheet") == h["sheet"]) & (F.col("row_no") > 1))
        cell = lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))
        filled = lambda at: F.array_distinct(F.filter(F.array(*[cell(i) for i in at]), lambda x: x != "")) if at else F.expr("cast(array() as array<string>)")
        fields = [(F.array_join(filled(at), "; ") if name in JOINED else F.coalesce(F.get(filled(at), 0), F.lit(""))).alias(name) for name, at in where.items()]
        part = rows.select(F.element_at(F.split("file", "/"), -1).alias("index"), "sheet", (F.col("row_no") - 1).alias("position"), *fields).filter("title <> '' or url <> ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = ", ".join(["index string", "sheet string", "position int", *[f"{n} string" for n in HEADERS]])
        return sheets.sparkSession.createDataFrame([], empty)
    return out


REGISTRY = "chave string, ano int, num_bte int, familia string, tipo string, posicao int, url string, ficheiro string, descarga struct<estado:string,sha256:string,etag:string,last_modified:string,caminho:string,erro:string>, nomeacao struct<ordinal:int,estado:string,doc_id:string,avisos:array<string>>"


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines) of a JSONL registry: of lines with one key the last wins (``line_no`` is its first); broken ones, or without a key, are kept apart."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", REGISTRY + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | (F.coalesce("r.chave", F.lit("")) == "")
    good = parsed.filter(~bad).groupBy(F.col("r.chave").alias("key")).agg(F.max_by("r", "line_no").alias("r"), F.min("line_no").alias("line_no"))
    return good.select("r.*", "line_no").drop("_corrupt"), parsed.filter(bad).select("line_no", "value")


def registry_types(entries: DataFrame) -> DataFrame:
    """(doc_id, type): of each named document the entry whose key comes first in the file."""
    return entries.filter("nomeacao.doc_id is not null").groupBy(F.col("nomeacao.doc_id").alias("doc_id")).agg(F.min_by("tipo", F.struct("line_no", "chave")).alias("type"))


def read_vocabulary(spark: SparkSession, path: str, key: str, value: str, allowed: list[str] | None = None, least: int = 0, last: bool = False) -> DataFrame:
    """(key, value, ord) of a ; CSV file with a header, comments and an optional byte-order mark; keys folded, one row each.

    Values outside ``allowed`` and keys shorter than ``least`` are left out; the first line of a key wins, or the last.
    """
    raw = spark.read.option("sep", ";").option("header", "true").option("comment", "#").option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]).withColumn("ord", F.monotonically_increasing_id())
    rows = raw.select(entity_key(key).alias("key"), F.trim(value).alias("value"), "ord").filter("key <> '' and value <> ''").filter(F.length("key") >= least)
    if allowed:
        rows = rows.filter(F.col("value").isin(*allowed))
    pick = F.max_by if last else F.min_by
    return rows.groupBy("key").agg(pick("value", "ord").alias("value"), F.min("ord").alias("ord"))


def read_acronyms(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, ord) of an acronym table (name, acronym, origin): rows whose first origin is the fallback are left out; the first wins."""
    raw = spark.read.option("sep", ";").option("header", "true").csv(path)
    names = {re.sub("[^a-z]", "", c.lower()): c for c in raw.columns}
    name, short = next(names[n] for n in ("nome", "nomecompleto", "denominacao") if n in names), names["sigla"]
    rows = raw.withColumn("ord", F.monotonically_increasing_id())
    if "origem" in names:
        rows = rows.filter(F.coalesce(F.split(names["origem"], r"\+")[0], F.lit("")) != "recurso")
    return rows.select(entity_key(name).alias("key"), F.trim(short).alias("value"), "ord").filter("key <> '' and value <> ''").groupBy("key").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def read_correspondence(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) names, both filled."""
    raw = spark.read.option("sep", ";").option("header", "true").csv(path)
    return raw.select(F.col("nome_anterior").alias("old"), F.col("nome_novo").alias("new")).filter("old <> '' and new <> ''")


def read_master_codes(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, guid, color, description) of a codebook exchange file: a code is found by its name, the name without its number, its number, and the
    number without leading zeros; the first code of a key wins."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        for frame in frames:
            out = []
            for data in frame["content"]:
                for k, e in enumerate(x for x in ET.fromstring(bytes(data)).iter() if x.tag.endswith("}Code") or x.tag == "Code"):
                    note = next((c.text for c in e if c.tag.endswith("Description")), None)
                    out.append((k, e.get("name"), e.get("guid"), e.get("color"), note))
            yield pd.DataFrame(out, columns=["ord", "name", "guid", "color", "description"])

    codes = files.mapInPandas(run, "ord long, name string, guid string, color string, description string").filter("name <> ''")
    number = F.regexp_extract("name", r"^(\d+(?:\.\d+)*)", 1)
    plain = F.array_join(F.transform(F.split(number, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ".")
    keys = F.array_distinct(F.filter(F.array(F.col("name"), F.trim(F.regexp_replace("name", r"^\d+(?:\.\d+)*\s*", "")), number, plain), lambda x: x != ""))
    return codes.withColumn("key", F.explode(keys)).groupBy("key").agg(F.min_by(F.struct("name", "guid", "color", "description"), "ord").alias("x")).select("key", "x.*")


def find_code(codes: DataFrame, code: str, master: DataFrame) -> DataFrame:
    """Codes with the master's entry: by the exact key, else without leading zeros."""
    plain = F.array_join(F.transform(F.split(F.col(code), r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ".")
    a, b = master.select(F.col("key").alias("__k1"), F.struct("name", "color", "description").alias("__m1")), master.select(F.col("key").alias("__k2"), F.struct("name", "color", "description").alias("__m2"))
    out = codes.join(a, F.col(code) == F.col("__k1"), "left").join(b, plain == F.col("__k2"), "left")
    return out.withColumn("master", F.coalesce("__m1", "__m2")).drop("__k1", "__k2", "__m1", "__m2")


def gold_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, code, segment) of a reference sample (doc, code, segment as text): incomplete rows go; the code is the last > part's number."""
    last = F.trim(F.element_at(F.split("code", ">"), -1))
    number = F.regexp_extract(last, r"^(\d+(?:\.\d+)+)", 1)
    return cells.filter("trim(coalesce(doc_id, '')) <> '' and trim(coalesce(code, '')) <> '' and trim(coalesce(segment, '')) <> ''").select(F.trim("doc_id").alias("doc_id"), F.when(number != "", number).otherwise(last).alias("code"), "segment")


def subtype(registered, agreement) -> Column:
    """A document's subtype from two free-text variables."""
    a, b = F.lower(strip_accents(F.coalesce(registered, F.lit("")))), F.lower(strip_accents(F.coalesce(agreement, F.lit(""))))
    whole = F.contains(b, F.lit("texto consolidado"))
    return F.when(F.contains(a, F.lit("1")) & F.contains(a, F.lit("conven")), "primeira_convencao").when(F.contains(a, F.lit("global")), "revisao_global").when(F.contains(a, F.lit("parcial")) & whole, "revisao_parcial_com_consolidado").when(F.contains(a, F.lit("parcial")), "revisao_parcial").when(whole, "texto_consolidado").otherwise("desconhecido")


def pdf_folder(spark: SparkSession, path: str, scopes: tuple[str, ...] = ("PRI", "SPE")) -> DataFrame:
    """(path, length, modificationTime, content) of a folder's PDF files: its own, else those of the scope folders below ``convencoes``."""
    read = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(p)
    own = read(path)
    if not own.isEmpty():
        return own
    return read(f"{path}/convencoes/{{{','.join(scopes)}}}")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, text, error): pages of each file by the caller's reader; a file that fails gives one row with the error."""

    def run(frames):
        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    out += [(path, k, page, None) for k, page in enumerate(extractor(bytes(data)), 1)]
                except Exception as error:
                    out.append((path, 0, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")


def issue_documents(pages: DataFrame, issue: list[str], title: str) -> DataFrame:
    """(issue, title, first_page, last_page exclusive) of the documents that an issue's pages begin, by the pattern of their titles."""
    from pyspark.sql import Window

    found = pages.select(*issue, "page_no", F.posexplode(F.regexp_extract_all("text", F.lit(title), F.lit(0))).alias("at", "title"))
    w = Window.partitionBy(*issue).orderBy("page_no", "at")
    total = pages.groupBy(*issue).agg((F.max("page_no") + 1).alias("__end"))
    nxt = F.coalesce(F.lead("page_no").over(w), F.col("__end"))
    return found.join(total, issue).select(*issue, F.regexp_replace("title", r"\s+", " ").alias("title"), F.col("page_no").alias("first_page"), F.greatest(nxt, F.col("page_no") + 1).alias("last_page"))


def project_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the sources in project files."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        for frame in frames:
            out = []
            for data in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    root = ET.fromstring(z.read("project.qde"))
                    for s in (e for e in root.iter() if e.tag.endswith("}TextSource")):
                        out.append((s.get("name"), z.read("Sources/" + s.get("plainTextPath", "").removeprefix("internal://")).decode("utf-8")))
            yield pd.DataFrame(out, columns=["name", "text"])

    return files.mapInPandas(run, "name string, text string")


def doc_id_parts(doc_id) -> Column:
    """(scheme, year, issue, scope, seq, type, code, acronyms, others) of a document's name, by the scheme it follows; null for none."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    new = r"^(20\d{2})_BTE_(\d{1,2})_(PRI|SPE|APU)_(\d+)_([A-Z-]+)_(\d+)_(.+)$"
    other = r"^(20\d{2})_BTE_(\d{1,2})_(PE|PCT|PRT|AA|AVISO|AV)_(\d+)(?:_(\d{4}[A-Z]?-\d{4}))?_(\d+)_(.+)$"
    short = r"^(\d{2})_([A-Z]{2})_(\d+)_BTE_(\d+)_(.+)$"
    g = lambda p, k: F.regexp_extract(c, p, k)
    names = lambda tail, mark: F.filter(F.split(F.regexp_replace(tail, r"\+\d+$", ""), mark), lambda x: x != "")
    rest = lambda tail: F.coalesce(F.regexp_extract(tail, r"\+(\d+)$", 1).try_cast("int"), F.lit(0))
    row = lambda scheme, y, i, scope, seq, kind, code, tail, mark: F.struct(F.lit(scheme).alias("scheme"), y.cast("int").alias("year"), i.cast("int").alias("issue"), scope.alias("scope"), seq.cast("int").alias("seq"), kind.alias("type"), code.alias("code"), names(tail, mark).alias("acronyms"), rest(tail).alias("others"))
    none = F.lit(None).cast("string")
    return (
        F.when(c.rlike(new), row("scope", g(new, 1), g(new, 2), g(new, 3), g(new, 4), g(new, 5), g(new, 6), g(new, 7), "-"))
        .when(c.rlike(other), row("family", g(other, 1), g(other, 2), none, g(other, 4), g(other, 3), g(other, 6), g(other, 7), "-"))
        .when(c.rlike(short), row("short", F.concat(F.lit("20"), g(short, 1)), g(short, 4), none, g(short, 3), g(short, 2), none, g(short, 5), "_"))
    )


def version_folder(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """(stem, folder): the first folder in order whose collapsed name lies in the document's collapsed name."""
    d = documents.select("stem", collapsed("stem").alias("__d"))
    f = folders.select("folder", collapsed("folder").alias("key"), F.col("folder").alias("value"), F.col("folder").alias("ord")).filter("key <> ''")
    from ..operators.lookup import lookup

    return lookup(d.withColumnRenamed("__d", "name"), "name", f.select("key", "value", "ord"), 1, longest=False).select("stem", F.col("value").alias("folder"))
