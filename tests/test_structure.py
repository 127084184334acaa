"""Lines, segments, outline: laws over random texts, and known cases."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import lines, sanity, structure

KINDS = ["CAPÍTULO {n}", "SECÇÃO {r}", "ANEXO {r}", "Cláusula {n}.ª", "Artigo {n}.º", "{n}- {w}.", "a) {w};", "{w}", "{w}.", "Texto consolidado", "\x02TABELA\nA | B\n{n} | 2\n\x03TABELA", "Pela {w}:", "Lisboa, 12 de maio de 2025."]
WORDS = "o trabalhador tem direito a férias Acordo entre empresa e sindicato outubro Âmbito".split()


def random_text(r):
    return "\n".join(r.choice(KINDS).format(n=r.randint(1, 40), r=r.choice(["I", "II", "IV"]), w=" ".join(r.choices(WORDS, k=r.randint(1, 12)))) for _ in range(r.randint(1, 40)))


def outlines(spark, texts):
    """(text, nodes) of every (text, subtype), all at once."""
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id int, text string, subtype string")
    rows = {r["doc_id"]: (r["text"], [n.asDict() for n in r["nodes"]]) for r in structure.structure(docs, subtype="subtype").collect()}
    return [rows[k] for k in range(len(texts))]


def test_leaves_tile_the_text(spark):
    cases = []
    for seed in range(150):
        r = random.Random(seed)
        cases.append((random_text(r), r.choice(["", "texto_consolidado"])))
    for text, nodes in outlines(spark, cases):
        leaves = sorted((n["char_start"], n["char_end"]) for n in nodes if n["leaf"])
        assert not leaves and not text or leaves[0][0] == 0 and leaves[-1][1] == len(text)
        assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
        ids = {n["node_id"] for n in nodes}
        assert len(ids) == len(nodes) and all(n["parent_id"] is None or n["parent_id"] in ids for n in nodes)
        assert all(n["char_start"] < n["char_end"] for n in nodes)


@pytest.fixture
def outline_of(spark):
    return lambda *rows, subtype="": outlines(spark, [("\n".join(rows), subtype)])[0]


def kinds(nodes):
    return [(n["type"], n["label"]) for n in nodes]


def test_titles_and_parents(outline_of):
    text, nodes = outline_of("Acordo X", "CAPÍTULO I", "Âmbito", "Cláusula 1.ª", "Área", "Aplica-se a", "todos.", "Cláusula 2.ª Vigência", "Dois anos.")
    assert kinds(nodes) == [("preamble", "PREAMBLE"), ("chapter", "CAPÍTULO I - Âmbito"), ("clause", "Cláusula 1.ª - Área"), ("clause", "Cláusula 2.ª - Vigência")]
    assert nodes[2]["parent_id"] == nodes[1]["node_id"] and "Aplica-se a todos.\n" in text


def test_what_is_no_heading(outline_of):
    _, nodes = outline_of("Cláusula 1.ª - A", "Os valores são:", "Cláusula 44.ª, número 2 - Valor,", "Cláusula 28.ª - Deslocações - 16,55 €;", "nos termos do", "artigo 253.º do Código.", "Cláusula geral e transitória da lei.")
    assert [n["label"] for n in nodes if n["type"] in ("clause", "article")] == ["Cláusula 1.ª - A"]


def test_body_on_the_heading_line(outline_of):
    text, nodes = outline_of("Artigo 7.º Serão ainda sujeitos ao teste todos os trabalhadores que o solicitem.", "Artigo 8.º Revogado.")
    assert [n["label"] for n in nodes] == ["Artigo 7.º", "Artigo 8.º"] and "Revogado.\n" in text


def test_annex_parts_and_tables(outline_of):
    _, nodes = outline_of("ANEXO II", "\x02TABELA", "a | b", "c | d", "\x03TABELA", "ANEXO II-A", "Texto corrido da parte.", "ANEXO III", "Outro.")
    by = {n["label"]: n for n in nodes}
    assert by["ANEXO II-A - Texto corrido da parte."]["parent_id"] == by["ANEXO II"]["node_id"] and by["ANEXO III - Outro."]["parent_id"] is None


def test_consolidated_part_signatures_and_paragraphs(outline_of):
    text, nodes = outline_of("Artigo 1.º", "Alteração", "1- Muda a", "cláusula.", "2- E outra.", "Pela Empresa, SA:", "Texto consolidado", "Cláusula 1.ª", "Âmbito", "Fica assim.")
    assert [n["origin"] for n in nodes if n["type"] == "clause"] == ["consolidated"]
    assert [n["label"] for n in nodes if n["type"] == "paragraph"] == ["1- Muda a cláusula.", "2- E outra."]
    assert any(n["label"] == "SIGNATURES" and text[n["char_start"] : n["char_end"]].startswith("Pela Empresa") for n in nodes)


def test_structure_over_a_table(spark):
    docs = spark.createDataFrame([(1, "Cláusula 1.ª\nÂmbito\nTexto."), (2, None), (3, "")], "doc_id int, text string")
    out = structure.structure(docs)
    assert out.filter("error is not null").count() == 0
    nodes = structure.node_table(out)
    assert nodes.count() == 1 and structure.zero_loss(nodes, out).count() == 0


def test_lines_and_offsets(spark):
    docs = spark.createDataFrame([(1, "ab\n\n🙂c"), (2, ""), (3, None), (4, "x\n")], "doc_id int, text string")
    rows = lines.lines(docs, ["doc_id"])
    got = {(r["doc_id"], r["line_no"]): (r["line"], r["char_start"], r["char_end"]) for r in rows.collect()}
    assert got == {(1, 1): ("ab", 0, 3), (1, 2): ("", 3, 4), (1, 3): ("🙂c", 4, 6), (2, 1): ("", 0, 0), (4, 1): ("x", 0, 2), (4, 2): ("", 2, 2)}


def test_random_spacing_round_trips(spark):
    r = random.Random(3)
    texts = [(k, "".join(r.choice("ab |\n🙂") for _ in range(r.randint(5, 60)))) for k in range(25)]
    points = [(k, p) for k, t in texts for p in sorted(r.sample(range(1, len(t)), min(4, len(t) - 1)))]
    spans = [(k, *sorted(r.sample(range(len(t) + 1), 2))) for k, t in texts for _ in range(4)]
    docs, pts = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(points, "doc_id int, point int")
    out = lines.remap(spark.createDataFrame(spans, "doc_id int, char_start int, char_end int"), pts, ["doc_id"]).collect()
    wide = {x["doc_id"]: x["spaced"] for x in lines.spaced(docs, pts, ["doc_id"]).collect()}
    put = {}
    for x in lines.inserted_positions(pts, ["doc_id"]).collect():
        put.setdefault(x["doc_id"], set()).add(x["position"])
    for x in out:
        piece = "".join(c for i, c in enumerate(wide[x["doc_id"]][x["new_start"] : x["new_end"]], x["new_start"]) if i not in put.get(x["doc_id"], ()))
        assert piece == dict(texts)[x["doc_id"]][x["char_start"] : x["char_end"]]


def test_tagged_text(spark):
    raw = "#TEXT 25_PR_001\n#CODE Preâmbulo\n\nEntre A e B\n\n#ENDCODE\nlost\n#CODE Artigo\\Artigo 1.º - X\numa\nduas\n#ENDCODE\n#TEXT 2\n#CODE C\nz\n#ENDCODE"
    rows = spark.createDataFrame([("f", k, line) for k, line in enumerate(raw.split("\n"))], "file string, line_no int, line string")
    got = sorted((r["doc_id"], r["label"], r["text"], r["char_start"], r["char_end"]) for r in lines.tagged_text(rows).collect())
    assert got == [("2", "C", "z\n", 0, 2), ("25_PR_001", "Artigo 1.º - X", "uma\nduas\n", 12, 21), ("25_PR_001", "Preâmbulo", "Entre A e B\n", 0, 12)]


def test_furniture(spark):
    pages = [(1, p, k, line) for p in range(6) for k, line in enumerate(["Header", f"text {p}", f"more {p}", "mid", f"z{p}", f"{p}"])]
    rows = spark.createDataFrame(pages, "doc_id int, page_no int, line_no int, line string")
    assert [(r["line"], r["n_pages"]) for r in lines.furniture(rows, ["doc_id"], ["doc_id", "page_no"]).collect()] == [("Header", 6)]
    assert lines.without_furniture(rows, ["doc_id"], ["doc_id", "page_no"]).filter("line = 'Header'").count() == 0


def test_furniture_forms(spark):
    rows = ["Boletim do Trabalho e Emprego 31", "22 agosto 2026", "BTE 31 | 34", "BTE | 100", "publicado no Boletim do Trabalho e Emprego, n.º 21, de 8 de junho", "Boletim do Trabalho e Emprego, n.º 31, 22/8/2026"]
    df = spark.createDataFrame([(r,) for r in rows], "line string").select(sanity.is_furniture("line").alias("f"))
    assert [r["f"] for r in df.collect()] == [True, True, True, True, False, True]
    cut = spark.createDataFrame([("fim Boletim do Trabalho e Emprego 28 29 agosto 2025 x", "Boletim do Trabalho e Emprego 31 22 agosto 2026 Deve ler-se")], "a string, b string").select(sanity.without_dated_header("a").alias("a"), sanity.without_header_prefix("b").alias("b")).first()
    assert (cut["a"], cut["b"]) == ("fim  x", "Deve ler-se")  # the blank before goes, the one after stays


def test_empty_clauses(spark):
    rows = [("Cláusula 1.ª\nTexto fechado.\n", "clause"), ("Cláusula 2.ª\n", "clause"), ("Cláusula 3.ª\nsem fim\n", "clause"), ("Cláusula 4.ª\nRH = x\n", "clause"), ("Artigo 5.º\nAs cláusulas passam a ter a redação seguinte:\n", "article"), ("Cláusula 6.ª\n( Revogado. )\n", "clause"), ("Cláusula 7.ª\nnomeadamente:\n", "clause"), ("Cláusula 8.ª\nFim.\n", "clause")]
    at, nodes = 0, []
    for k, (span, kind) in enumerate(rows):
        nodes.append((1, f"n{k}", kind, span.split("\n")[0], at, at + len(span), None, "new", True, k, span))
        at += len(span)
    df = spark.createDataFrame(nodes, "doc_id int, node_id string, type string, label string, char_start int, char_end int, parent_id string, origin string, leaf boolean, ord int, span string")
    got = {r["node_id"]: r["problem"] for r in sanity.clauses_without_body(df).collect()}
    assert got == {"n1": "empty", "n2": "no closed sentence", "n6": "no closed sentence"}
    ref = spark.createDataFrame([(1, "x nomeadamente Cláusula 8 ª Fim".split())], "doc_id int, words array<string>")
    assert "n6" not in {r["node_id"] for r in sanity.clauses_without_body(df, ref).collect()}


def test_deposit_note(spark):
    rows = [("Texto.\nDepositado em 23 de janeiro de 2026.", None), ("Texto.", "no deposit note"), ("Depositado a 7 de agosto\nde 2026.\nmais", "1 line(s) after the deposit note"), ("", "empty document")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string")
    assert [r["p"] for r in df.select(sanity.deposit_problem("text", F.lit(False)).alias("p")).collect()] == [p for _, p in rows]
    assert df.select(sanity.is_correction(F.lit("Acordo entre A e B - Retificação\nCláusula 1.ª")).alias("c")).first()["c"]


def test_missing_tables(spark):
    rows = [("a1", "annex", "ANEXO I - Tabela salarial", None, "ANEXO I\n"), ("b1", "block", "Body", "a1", "só texto\n"), ("a2", "annex", "ANEXO II - Vencimentos", None, "ANEXO II\n"), ("b2", "block", "Body", "a2", "A | B\n"), ("a3", "annex", "ANEXO III - Salários", None, "ANEXO III\n"), ("b3", "block", "Body", "a3", "1 087,90 e 88,20 e 3,50\n")]
    df = spark.createDataFrame([(1, i, k, lab, 10 * n, 10 * n + 9, p, "new", True, n, s) for n, (i, k, lab, p, s) in enumerate(rows)], "doc_id int, node_id string, type string, label string, char_start int, char_end int, parent_id string, origin string, leaf boolean, ord int, span string")
    assert [(r["node_id"], r["problem"]) for r in sanity.missing_tables(df).collect()] == [("a1", "table outside the annex")]
    img = spark.createDataFrame([(1, ["p3"])], "doc_id int, pages array<string>")
    assert "image" in sanity.missing_tables(df, img).first()["problem"]


def test_secrets(spark):
    df = spark.createDataFrame([(1, "password = 'abcdefghijklmnop1'"), (2, "nothing")], "doc_id int, text string")
    assert [(r["doc_id"], r["rule"]) for r in sanity.secrets(df).collect()] == [(1, "assigned secret")]
