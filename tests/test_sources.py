"""Files in and out, streams, and parity of the registered queries with their SQL on the smallest tables."""

import json
import math
import zipfile
from xml.etree import ElementTree as ET

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexspan.sources import files, sinks
from lexspan.streaming import registry as streams

DATA = "/root/testdata/sf0.001"


def write_xlsx(path, sheets):
    """A minimal workbook with inline strings."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, table in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(table, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_index_sheets(spark, tmp_path):
    head = ["ANO:", "TÍTULO DO DOCUMENTO:", "TIPO DE DOCUMENTO:", "DocAlteradosPorEste", "DocAlteradosPorEste2", "TIPO DE DOCUMENTO:", "URLPDF"]
    write_xlsx(tmp_path / "i.xlsx", {"A": [head, ["2025", "T1", "CCT", "x", "y", None, "u"], [None, None, "AE"], [None, "T2", None, "x", "x", "AE"]], "other": [["a"], ["b"]]})
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    sheets = files.read_sheets(spark, str(tmp_path))
    assert sheets.filter("error is not null").count() == 1
    got = sorted((r["title"], r["type"], r["alters"], r["position"]) for r in files.index_rows(sheets).collect())
    assert got == [("T1", "CCT", "x; y", 1), ("T2", "AE", "x", 3)]


def test_registry_lines(spark, tmp_path):
    good = [{"chave": "a", "ano": 2025, "tipo": "CCT"}, {"chave": "b", "nomeacao": {"doc_id": "d1", "ordinal": 3}, "tipo": "AE"}, {"chave": "a", "ano": 2026, "tipo": "CCT-ALT"}]
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(good[0]), "{broken", "", '{"ano": 1}', *map(json.dumps, good[1:])]))
    entries, rejected = files.read_registry(spark, str(tmp_path / "r.jsonl"))
    assert {r["chave"]: r["ano"] for r in entries.collect()} == {"a": 2026, "b": None} and rejected.count() == 2
    assert [tuple(r) for r in files.registry_types(entries).collect()] == [("d1", "AE")]
    sinks.write_registry(entries, str(tmp_path / "out"))
    assert files.read_registry(spark, str(tmp_path / "out"))[0].count() == 2


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.csv").write_text("﻿nome;ambito\n# comment\nBanco A;SPE\nbanco a.;PRI\nX;??\nÁgua;APU\n", encoding="utf-8")
    got = {r["key"]: r["value"] for r in files.read_vocabulary(spark, str(tmp_path / "v.csv"), "nome", "ambito", ["PRI", "SPE", "APU"]).collect()}
    assert got == {"banco a": "SPE", "agua": "APU"}
    (tmp_path / "s.csv").write_text("nome;sigla;origem\nUm;U1;registo\nUm;U2;registo\nDois;D;recurso+x\n", encoding="utf-8")
    assert {r["key"]: r["value"] for r in files.read_acronyms(spark, str(tmp_path / "s.csv")).collect()} == {"um": "U1"}


def test_master_codes(spark, tmp_path):
    (tmp_path / "m.qdc").write_text('<CodeBook xmlns="urn:QDA-XML:codebook:1.0"><Codes><Code name="4.08 Dados" guid="g1" color="#f00"><Description>d</Description><Code name="04.08.1 Outro" guid="g2"/></Code></Codes></CodeBook>')
    master = files.read_master_codes(spark, str(tmp_path / "m.qdc"))
    codes = spark.createDataFrame([("4.08",), ("4.08.1",), ("9",)], "code string")
    assert {r["code"]: (r["master"] or {"name": None})["name"] for r in files.find_code(codes, "code", master).collect()}["4.08"] == "4.08 Dados"


def test_codebook_file(tmp_path):
    from lexspan.operators.coding import Codebook

    (tmp_path / "c.yaml").write_text("eixos: [{id: '4.1'}]\ncodigos:\n- id: 4.1.1\n  nome: N\n  termos: [a, b]\n  condicoes: {requer_algum: [c], excluir: [d]}\n")
    book = Codebook.from_yaml(str(tmp_path / "c.yaml"))
    assert book.axes == ("4.1",) and book.codes[0].terms == ("a", "b") and book.codes[0].excludes == ("d",)


def test_pages_from_files(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.pdf").write_bytes(b"x\fy" if n == "a" else b"bad")

    def reader(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().split("\f")

    got = sorted((r["page_no"], r["text"], r["error"]) for r in files.extract_pages(files.pdf_folder(spark, str(tmp_path)), reader).collect())
    assert got == [(0, None, "ValueError: broken"), (1, "x", None), (2, "y", None)]
    pages = spark.createDataFrame([(1, 1, "Acordo de empresa A ... Acordo de empresa B"), (1, 3, "Acordo de empresa C"), (1, 5, "end")], "issue int, page_no int, text string")
    docs = files.issue_documents(pages, ["issue"], r"Acordo de empresa \w")
    assert sorted((r["title"][-1], r["first_page"], r["last_page"]) for r in docs.collect()) == [("A", 1, 2), ("B", 1, 3), ("C", 3, 6)]


def test_doc_ids(spark):
    ids = ["2026_BTE_31_PRI_377_CCT-ALT_27251_ACRAL-CESP+2", "2026_BTE_05_PE_12_0452-2025_27251_X-Y", "26_PR_003_BTE_31_EMARP_SINTAP", "other"]
    got = [r["p"] for r in spark.createDataFrame([(i,) for i in ids], "d string").select(files.doc_id_parts("d").alias("p")).collect()]
    assert (got[0]["scope"], got[0]["seq"], got[0]["acronyms"], got[0]["others"]) == ("PRI", 377, ["ACRAL", "CESP"], 2)
    assert (got[1]["type"], got[1]["year"]) == ("PE", 2026) and (got[2]["year"], got[2]["issue"], got[2]["acronyms"]) == (2026, 31, ["EMARP", "SINTAP"]) and got[3] is None


def test_subtypes(spark):
    cases = [("1.ª convenção", "", "primeira_convencao"), ("Revisão GLOBAL", "", "revisao_global"), ("Revisão parcial", "Alteração e texto consolidado", "revisao_parcial_com_consolidado"), ("revisão parcial", None, "revisao_parcial"), (None, "Texto consolidado", "texto_consolidado"), (None, None, "desconhecido")]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(files.subtype("a", "b").alias("s"))
    assert [r["s"] for r in df.collect()] == [c[2] for c in cases]


def test_project_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "um 🙂 dois\ntrês"), (2, "só")], "doc_id int, text string")
    notes = spark.createDataFrame([(1, 3, 4, "AUTO/4.08.1", 0.7, "lexical", "x"), (1, 0, 15, "REVIEW/4.08", 0.6, "lexical", None)], "doc_id int, char_start int, char_end int, code string, confidence double, method string, evidence string")
    points = spark.createDataFrame([(1, 10)], "doc_id int, point int")
    path = sinks.write_project(docs, notes, points, str(tmp_path / "p.qdpx"))
    texts = {r["name"]: r["text"] for r in files.project_texts(spark, path).collect()}
    assert texts == {"1": "um 🙂 dois\n\ntrês"[:10] + "\n" + "um 🙂 dois\ntrês"[10:], "2": "só"}
    with zipfile.ZipFile(path) as z:
        root = ET.fromstring(z.read("project.qde"))
    spans = sorted((int(e.get("startPosition")), int(e.get("endPosition"))) for e in root.iter() if e.tag.endswith("PlainTextSelection"))
    names = [e.get("name") for e in root.iter() if e.tag.endswith("}Code")]
    assert spans == [(0, 16), (3, 4)] and names == ["AUTO", "4.08", "4.08.1", "REVIEW", "4.08"]
    refs, guids = {e.get("targetGUID") for e in root.iter() if e.tag.endswith("CodeRef")}, {e.get("guid") for e in root.iter() if e.tag.endswith("}Code")}
    assert refs <= guids and len(guids) == 5


def test_review_rows_and_manifest(spark, tmp_path):
    t = "doc_id int, node_id string, type string, label string, parent_id string"
    nodes = spark.createDataFrame([(1, "n1", "chapter", "CAP I", None), (1, "n2", "clause", "Cl 1", "n1"), (1, "n2p1", "paragraph", "1-", "n2")], t)
    notes = spark.createDataFrame([(1, "n2p1", 0, 6, "4.1", "paragraph", 0.6, "lexical", "e")], "doc_id int, node_id string, char_start int, char_end int, code string, level string, confidence double, method string, evidence string")
    r = sinks.review_rows(notes, nodes, spark.createDataFrame([(1, " abc  x")], "doc_id int, text string")).first()
    assert (r["segment"], r["clause"], r["context"]) == ("abc", "Cl 1", "CAP I")
    (tmp_path / "a.bin").write_bytes(b"hello")
    listed = sinks.manifest(spark.read.format("binaryFile").load(str(tmp_path)), "in")
    assert listed.first()["size_bytes"] == 5
    (tmp_path / "a.bin").write_bytes(b"other")
    (tmp_path / "b.bin").write_bytes(b"")
    held = spark.createDataFrame([tuple(r) for r in [("x", "1")]], "path string, sha256 string")
    assert sinks.check_manifest(held, sinks.manifest(spark.read.format("binaryFile").load(str(tmp_path)), "in")).groupBy("state").count().count() == 2


def test_upserts_by_stream(spark, tmp_path):
    schema, source = "k int, n int, a string, b string", tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"k": 1, "n": 1, "a": "x", "b": "y"}\n{"k": 1, "n": 2, "a": "", "b": "z"}\n')
    run = lambda: streams.upsert_stream(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "n", ["a", "b"]).awaitTermination()
    run()
    (source / "2.json").write_text('{"k": 1, "n": 3, "a": "w", "b": ""}\n{"k": 2, "n": 4, "a": "q"}\n')
    run()
    got = sorted((r["k"], r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "out/snapshot=1")).collect())
    assert got == [(1, "w", "z"), (2, "q", None)]


def test_windows_by_stream(spark, tmp_path):
    rows = [("2026-01-01 10:05:00", "a"), ("2026-01-01 10:50:00", "a"), ("2026-01-01 11:00:00", "b"), ("2026-01-02 11:00:00", "c")]
    spark.createDataFrame(rows, "ts string, state string").select(F.col("ts").cast("timestamp").alias("ts"), "state").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("ts timestamp, state string").parquet(str(tmp_path / "t"))
    q = streams.state_counts(stream, "ts", "state").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["state"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def normal(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "∅"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "if" else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def registered():
    from lexspan import catalog

    return sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registered())
def test_parity(spark, duck, name):
    from lexspan import catalog

    got = catalog.QUERIES[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(rows.columns) == sorted(want.columns) and normal(rows) == normal(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
