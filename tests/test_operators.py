"""Coding, evaluation, versions, registry, catalogue, acronyms, geometry: known answers and laws."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import acronyms, catalogue, coding, diff, evaluation, geometry, lookup, registry

BOOK = coding.Codebook((coding.Code("4.1.1", ("dados pessoais", "privacidade")), coding.Code("4.1.2", ("quota",), ("dados",), ("sindical",)), coding.Code("5.1", ("câmara",))), ("4.1", "5"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_coding_rules(spark):
    spans = spark.createDataFrame([(1, "Os Dados Pessoais e a PRIVACIDADE"), (2, "quota de dados"), (3, "quota sindical de dados"), (4, "quota"), (5, None)], "id int, span string")
    got = coding.coded(spans, "span", BOOK)
    assert rows(got, "id", "code", "n_hits", "confidence", "evidence") == [(1, "4.1.1", 2, 0.7, "dados pessoais"), (2, "4.1.2", 1, 0.6, "quota")]
    assert rows(coding.axis_rows(got, ["id"], BOOK), "id", "axis", "evidence") == [(1, "4.1", "dados pessoais"), (2, "4.1", "quota")]


def test_confidence_has_a_ceiling(spark):
    book = coding.Codebook((coding.Code("1.1", tuple("abcdefg")),))
    assert coding.coded(spark.createDataFrame([("a b c d e f g",)], "s string"), "s", book).first()["confidence"] == 0.9


def test_drill_down_to_paragraphs_or_clause(spark):
    clauses = spark.createDataFrame([(1, "quota e dados; privacidade")], "id int, span string")
    paragraphs = spark.createDataFrame([(1, 1, "a quota"), (1, 2, "os dados")], "id int, p int, span string")
    got = coding.drill_down(clauses, paragraphs, ["id"], ["p"], "span", BOOK)
    assert rows(got.fillna(-1), "p", "code", "level") == [(-1, "4.1.1", "clause"), (1, "4.1.2", "paragraph")]


def test_triage(spark):
    metrics = spark.createDataFrame([("A", 0.95, 10), ("B", 0.4, 10), ("C", 1.0, 1), ("D", None, 0)], "code string, precision double, n_reference long")
    fit = coding.calibrated(metrics)
    assert rows(fit, "code") == [("A",)]
    notes = spark.createDataFrame([("A", "new", "c1", "lexical"), ("B", "new", "c1", "lexical"), ("A", "consolidated", "c2", "lexical"), ("A", "consolidated", "c3", "lexical"), ("Structure/Preamble", "new", "c0", "context"), ("A", "new", "c4", "model")], "code string, origin string, clause_id string, method string")
    novel = spark.createDataFrame([("c3",)], "clause_id string")
    assert rows(coding.triage(notes, fit, novel).fillna(""), "clause_id", "code", "band") == [("c0", "Structure/Preamble", ""), ("c1", "A", "AUTO"), ("c1", "B", "REVIEW"), ("c2", "A", "CONSOLIDATED"), ("c3", "A", "AUTO"), ("c4", "A", "REVIEW")]


def test_batches_close_before_the_limit(spark):
    df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([5, 4, 20, 1, 9, 1])], "id int, k long, text string")
    assert [r[1] for r in rows(coding.size_batches(df, ["id"], "k", "text", 10), "k", "batch")] == [1, 1, 2, 3, 3, 4]


def test_model_calls_cache_errors_and_replies(spark):
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("boom",)], "prompt string")
    cache = spark.createDataFrame([("p1", "[]")], "prompt string, reply string").select(F.sha2("prompt", 256).alias("prompt_hash"), "reply")

    def backend(prompt):
        if prompt == "boom":
            raise RuntimeError("no")
        return 'x [{"idx": "3", "code": "4.1.1", "confidence": "0.8", "evidence": "e"}, {"idx": 1, "code": "9", "confidence": 0.9}, {"idx": 2, "code": "4.1.1", "confidence": 0.2}]'

    got = coding.ask(prompts, cache, backend).collect()
    assert len(got) == 3 and sum(r["error"] is not None for r in got) == 1
    items = coding.reply_items(spark.createDataFrame([(r["reply"],) for r in got if r["reply"]], "reply string"), "reply", ("4.1.1",))
    assert rows(items, "idx", "code", "confidence") == [(3, "4.1.1", 0.8)]


def test_harness(spark):
    gold = spark.createDataFrame([("d1", "A", "texto um"), ("d2", "A", "texto dois"), ("d3", "B", "texto três")], "doc_id string, code string, segment string")
    pred = spark.createDataFrame([("d1", "A", "x Texto  UM y"), ("d2", "A", "nada a ver"), ("d4", "A", "z")], "doc_id string, code string, text string")
    states = evaluation.pair_states(pred, gold)
    a, b = evaluation.scores(states).orderBy("code").collect()
    assert (a["tp"], a["fp"], a["fn"], a["tp_segment"]) == (2, 1, 0, 1) and a["precision"] == pytest.approx(2 / 3)
    assert b["precision"] is None and b["recall"] == 0 and b["f1"] == 0
    g = evaluation.scores(states, by_code=False).first()
    assert (g["tp"], g["fp"], g["fn"]) == (2, 1, 1) and g["recall"] == pytest.approx(2 / 3)


def test_completeness(spark):
    ref = spark.createDataFrame([(1, "um dois dois três")], "doc_id int, text string")
    got = spark.createDataFrame([(1, "um dois quatro")], "doc_id int, text string")
    r = evaluation.coverage(ref, got, ["doc_id"]).first()
    assert (r["missing"], r["extra"]) == (2, 1) and r["coverage"] == 0.5 and r["excess"] == pytest.approx(1 / 3)
    pages = spark.createDataFrame([(1, 1, "um dois"), (1, 2, "dois três")], "doc_id int, page int, text string")
    assert rows(evaluation.page_loss(pages, got, ["doc_id"], "page"), "page", "lost") == [(1, 0), (2, 2)]
    v = lambda c, e=0.0, o=1.0, r=0: spark.range(1).select(evaluation.verdict(F.lit(c), F.lit(e), F.lit(o), F.lit(r)).alias("v")).first()["v"]
    assert [v(1.0), v(0.99), v(0.96), v(1.0, 0.01), v(1.0, 0.0, 0.9), v(1.0, r=5), v(1.0, r=1)] == ["OK", "ATTENTION", "FAIL", "ATTENTION", "ATTENTION", "FAIL", "ATTENTION"]


def test_gate(spark):
    t = "doc string, metric string, value double"
    now, gold = spark.createDataFrame([("d", "cov", 0.97), ("d", "warn", 3.0), ("d", "n", 5.0), ("e", "cov", 1.0)], t), spark.createDataFrame([("d", "cov", 0.99), ("d", "warn", 5.0), ("d", "n", 5.0)], t)
    got = evaluation.gate(now, gold, ["doc"], {"cov": ("+", 0.005), "warn": ("-", 0), "n": ("=", 0)})
    assert rows(got, "metric", "state") == [("cov", "REGRESSION"), ("n", "same"), ("warn", "improved")]


def clause(n, title, body):
    return (f"Cláusula {n}.ª - {title}", f"cl{n}", title.lower(), f"Cláusula {n}.ª - {title}\n{body}")


def test_versions():
    old = [clause(1, "Âmbito", "O acordo aplica-se a todos."), clause(2, "Vigência", "Vigora por um ano completo e renova-se."), clause(3, "Férias", "Vinte e dois dias úteis de férias."), clause(4, "Faltas", "As faltas justificadas não descontam no salário.")]
    new = [clause(1, "Âmbito", "O acordo aplica-se a todos."), clause(2, "Vigência", "Vigora por dois anos completos e renova-se."), clause(3, "Formação", "Direito a quarenta horas anuais."), clause(4, "Teletrabalho", "É permitido por acordo escrito das partes."), clause(5, "Faltas", "As faltas justificadas não descontam no salário.")]
    got = diff.match_clauses(new, old)
    by = {(r[0] or r[1]): r for r in got}
    assert [by[n[0]][2] for n in new] == ["=", "alteracao", "nova", "nova", "="]
    assert by[new[4][0]][1] == old[3][0] and by[new[4][0]][4] and not by[new[0][0]][4]
    assert by[old[2][0]][2] == "removida" and "-Vigora por um ano" in by[new[1][0]][5]


def test_versions_over_a_table(spark):
    t = "pair int, ord int, label string, key string, title string, text string"
    new = spark.createDataFrame([(p, k, *clause(k, "T", f"corpo número {k} do par {p}.")) for p in (1, 2) for k in range(3)], t)
    old = new.filter("ord < 2")
    assert rows(diff.compare_versions(new, old, ["pair"]).groupBy("class").count(), "class", "count") == [("=", 4), ("nova", 2)]


def test_choose_pair(spark):
    v = spark.createDataFrame([("f", "3_BTE_2_X", 100), ("f", "24122_X", 90), ("f", "25146_X", 20), ("f", "19000_X", 95), ("f", "2024_BTE_3_X", 10)], "f string, name string, size int").withColumn("year", diff.file_year(F.col("name")))
    assert rows(diff.choose_pair(v, ["f"], "name", "year", "size"), "new", "old") == [("3_BTE_2_X", "24122_X")]


def test_lookups(spark):
    names = spark.createDataFrame([(1, "banco de portugal sa"), (2, "portugal"), (3, "x"), (4, "grande banco de portugal")], "id int, name string")
    keys = spark.createDataFrame([("portugal", "P", 0), ("banco de portugal", "B", 1), ("x", "X", 2)], "key string, value string, ord int")
    assert rows(lookup.lookup(names, "name", keys, 6).fillna(""), "id", "value") == [(1, "B"), (2, "P"), (3, "X"), (4, "B")]
    assert rows(lookup.lookup(names, "name", keys, 6, longest=False).fillna(""), "id", "value") == [(1, "P"), (2, "P"), (3, "X"), (4, "P")]


def test_prefix_needs_a_boundary(spark):
    left = spark.createDataFrame([("26_PR_003_BTE_31_EMARP_SINALCO",), ("26_PR_003_BTE_31_EMARP_SINTAP",)], "doc string")
    right = spark.createDataFrame([("26_PR_003_BTE_31_EMARP_SIN", 0), ("26_PR_003_BTE_31_EMARP", 1)], "cut string, n int")
    assert {r["cut"] for r in lookup.prefix_lookup(left, "doc", right, "cut", "n").collect()} == {"26_PR_003_BTE_31_EMARP"}


def test_ordinals_are_stable(spark):
    t = "part int, num int, key string, assigned int"
    df = spark.createDataFrame([(1, 5, "a", None), (1, None, "b", None), (1, 2, "c", 7), (1, 1, "d", 3), (2, 1, "e", None)], t)
    first = registry.ordinals(df, ["part"], "assigned", ["num", "key"])
    assert rows(first, "key", "ordinal") == [("a", 9), ("b", 8), ("c", 7), ("d", 3), ("e", 1)]
    again = registry.ordinals(first.withColumn("assigned", F.col("ordinal").cast("int")).drop("ordinal"), ["part"], "assigned", ["num", "key"])
    assert rows(again, "key", "ordinal") == rows(first, "key", "ordinal")


def test_upsert_never_erases(spark):
    t = "k int, a string, b string"
    out = registry.upsert(spark.createDataFrame([(1, "x", "y"), (2, "z", None)], t), spark.createDataFrame([(1, "", "n"), (3, "q", None)], t), ["k"])
    assert rows(out.fillna("-"), "k", "a", "b") == [(1, "x", "n"), (2, "z", "-"), (3, "q", "-")]


def test_references(spark):
    t = "key string, family string, type string, id string, code string, chain string"
    df = spark.createDataFrame([("a", "agreement", "CCT", "377/2026", "27251", ""), ("b", "agreement", "AE", "5/2025", "1", ""), ("c", "agreement", "AE", "5/2025", "2", ""), ("p", "extension", "PE", "9/2026", "", "CCT.20260822.377/2026; AE.20250101.5/2025"), ("q", "extension", "PE", "10/2026", "", "AE.20260822.377/2026")], t)
    assert rows(registry.resolve_base(df).filter("family <> 'agreement'"), "key", "base_codes", "unresolved") == [("p", "27251", 1), ("q", "", 1)]


def test_names(spark):
    f = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert f(registry.camel(F.lit("Águas do Norte, SA"))) == "AguasNorte" and f(registry.camel(F.lit("Sindicato Nacional dos Motoristas"))) == "Motoristas" and f(registry.camel(F.lit("de a"))) == "SemNome"
    assert f(registry.guessed_acronym(F.lit("Associação X (ACRAL)"))) == "ACRAL" and f(registry.guessed_acronym(F.lit("Sindicato dos Y - SITESE"))) == "SITESE" and f(registry.guessed_acronym(F.lit("Nome simples"))) is None
    assert f(registry.parties(F.lit(""), F.lit("Contrato coletivo entre a X e o Sindicato Y e outros"))) == ["X", "Sindicato Y"]
    assert f(registry.chosen_parties(F.array(F.lit("Sindicato A"), F.lit("Empresa B"), F.lit("Empresa C")))) == ["Empresa B", "Sindicato A"]
    assert f(registry.order_reference(F.lit("Portaria n.º 50-A/2025 de"), F.lit(2026))).asDict() == {"number": 50, "suffix": "A", "year": 2025}
    assert f(registry.order_reference(F.lit("Portaria n.º 7/2027"), F.lit(2026))) is None
    name = f(registry.compose_name(F.lit("2026_BTE_31_PRI_377_CCT-ALT_27251_"), F.array(F.lit("ABCDEFGHIJKLMNOPQRST"), F.lit("UVWXYZABCDEFGHIJKLMN")), F.lit(2)))
    assert len(name) <= 63 and name.endswith("+2") and name.startswith("2026_BTE_31_PRI_377_CCT-ALT_27251_ABC")


def catalogues(r):
    new, old = [], []
    for _ in range(r.randint(1, 8)):
        new.append((f"{r.randint(1, 2)}", "", "", "", "", "", r.choice("ab"), r.choice("nm"), "", "", "", "", "", "recolhido", ""))
    for k in range(r.randint(0, 8)):
        old.append((f"{r.randint(1, 2)}", "", "", "", "", "", r.choice("abc"), r.choice("nmo"), "", "", r.choice(["", f"note{k}"]), "", "", r.choice(["recolhido", f"state{k}"]), f"o{k}"))
    return new, old


@pytest.mark.parametrize("seed", range(4))
def test_merge_loses_and_copies_nothing(spark, seed):
    r = random.Random(seed)
    columns = [*catalogue.IDENTITY, "name", *catalogue.TEAM, "state", "ref"]
    schema = ", ".join(f"{c} string" for c in columns)
    new, old = catalogues(r)
    n, o = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    got = catalogue.merge(n, o).collect()
    for x in (x for x in old if x[10] or x[13] != "recolhido"):
        assert not x[10] or sum(g["notes"] == x[10] for g in got) == 1
        assert x[13] == "recolhido" or sum(g["state"] == x[13] for g in got) == 1
    assert len(got) >= len(new)
    held = spark.createDataFrame([tuple(g[c] for c in columns) for g in got], schema)
    again = catalogue.merge(n, held).fillna("")
    assert rows(again, *columns, "warning") == sorted(tuple(g[c] or "" for c in [*columns, "warning"]) for g in got)


def test_acronyms_are_unique_and_stable(spark):
    t = "code string, name string, base string, municipality string, last_activity string"
    orgs = [("1.402.1", "Sindicato dos Escritórios", "SITESE", "Lisboa", "2001"), ("1.402.3", "Sindicato dos Serviços", "SITESE", "Lisboa", "2020"), ("5.10.0", "Sindicato dos Motoristas", "SNM", "Porto", "2020"), ("14.23.0", "Sindicato Nacional dos Marinheiros", "snm", "Faro", "2019"), ("9.9.9", "Outra", "UNI", "", "")]
    r = random.Random(1)
    first = None
    for _ in range(2):
        r.shuffle(orgs)
        got = rows(acronyms.assign(spark.createDataFrame(orgs, t)), "lineage", "base", "acronym")
        assert first in (None, got)
        first = got
    by = {(a, b): c for a, b, c in first}
    assert by[("1.402", "SITESE")] == "SITESE" and by[("5.10", "SNM")] == "SNM" and by[("14.23", "snm")] == "snmarinheiros"
    fixed = spark.createDataFrame([("14.23", "snm", "SNM")], "lineage string, base string, acronym string")
    held = {(a, b): c for a, b, c in rows(acronyms.assign(spark.createDataFrame(orgs, t), fixed), "lineage", "base", "acronym")}
    assert held[("14.23", "snm")] == "SNM" and held[("5.10", "SNM")] != "SNM" and len({c.upper() for c in held.values()}) == len(held)


def test_geometry(spark):
    g = spark.createDataFrame([(1, 1, "a", 0.0, 10.0, 5.0, 18.0), (1, 2, "b", 5.5, 10.2, 10.0, 18.0), (1, 3, "c", 20.0, 10.0, 25.0, 18.0), (1, 4, "d", 0.0, 40.0, 5.0, 48.0), (1, 5, "z", -20.0, 1.0, -5.0, 9.0)], "page int, glyph_id int, text string, x0 double, top double, x1 double, bottom double")
    page = geometry.on_page(g, F.lit(100.0), F.lit(100.0))
    assert rows(geometry.text_lines(page, ["page"]), "line_no", "line") == [(1, "ab c"), (2, "d")]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 30.0, 30.0), (1, 2, 1.0, 1.0, 20.0, 20.0), (1, 3, 50.0, 0.0, 60.0, 90.0)], "page int, box_id int, x0 double, top double, x1 double, bottom double")
    assert rows(geometry.inside(page, boxes, ["page"]), "glyph_id", "box_id") == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    assert rows(geometry.outside(page, boxes, ["page"]), "glyph_id") == [(4,)] and rows(geometry.nested_boxes(boxes, ["page"]), "box_id", "outer_id") == [(2, 1)] and rows(geometry.tall_boxes(boxes), "box_id") == [(3,)]
    hidden = spark.createDataFrame([(1, "c", 20.05, 10.0)], "page int, text string, x0 double, top double")
    assert rows(geometry.without_hidden(page, hidden, ["page"]), "glyph_id") == [(1,), (2,), (4,)]
    cells = spark.createDataFrame([(1, 1, 2, "b "), (1, 1, 1, None), (1, 2, 1, ""), (1, 2, 2, None)], "t int, row_no int, column_no int, text string")
    assert rows(geometry.table_text(cells, ["t"]), "row_no", "line") == [(1, " | b")]


ORG = "code string, name string, base string, municipality string, last_activity string"


def assigned(spark, orgs, fixed=None):
    held = None if fixed is None else spark.createDataFrame(fixed, "lineage string, base string, acronym string")
    return {(a, b): c for a, b, c in rows(acronyms.assign(spark.createDataFrame([(*o, *("", "2020-01-01")[len(o) - 3 :]) for o in orgs], ORG), held), "lineage", "base", "acronym")}


def test_acronym_cases(spark):
    alone = [("1.1.0", "SINDICATO DOS PESCADORES DE SETUBAL", "SPS"), ("5.1.0", "ASSOCIACAO DOS ARMADORES DA PESCA", "ADAPLA")]
    snm = [("1.402.1", "SINDICATO NACIONAL DOS MOTORISTAS", "SNM"), ("1.100.0", "SINDICATO NACIONAL DA MARINHA MERCANTE", "SNM")]
    assert assigned(spark, alone) == {("1.1", "SPS"): "SPS", ("5.1", "ADAPLA"): "ADAPLA"}
    assert assigned(spark, snm) == assigned(spark, snm[::-1]) == {("1.100", "SNM"): "SNM", ("1.402", "SNM"): "SNMotoristas"}
    held = assigned(spark, snm, [("1.402", "SNM", "SNM")])
    assert held[("1.402", "SNM")] == "SNM" and held[("1.100", "SNM")] == "SNMarinha"
    assert set(assigned(spark, [("1.402.1", "SINDICATO DOS TRABALHADORES DE ESCRITORIO", "SITESE"), ("1.402.3", "SINDICATO DOS TRABALHADORES E TECNICOS", "SITESE")]).values()) == {"SITESE"}
    case = assigned(spark, [("1.1.0", "ALGUMA COISA", "SNMotoristas"), ("2.1.0", "OUTRA COISA", "SNMOTORISTAS")])
    assert len({c.upper() for c in case.values()}) == 2
    many = assigned(spark, [(f"{i}.1.0", "ASSOCIACAO COMERCIAL DE ESPINHO", "ACE", "ESPINHO") for i in range(1, 40)])
    assert len({c.upper() for c in many.values()}) == 39 and many[("1.1", "ACE")] == "ACE" and many[("2.1", "ACE")] == "ACEspinho"
    long = assigned(spark, [("5.1.0", "ASSOCIACAO COMERCIAL DO CONCELHO DE GONDOMAR", "COMERCIALCONCELHO", "GONDOMAR"), ("5.2.0", "ASSOCIACAO COMERCIAL DO CONCELHO DE OEIRAS", "COMERCIALCONCELHO", "OEIRAS")])
    assert long == {("5.1", "COMERCIALCONCELHO"): "COMERCIALCONCELHO", ("5.2", "COMERCIALCONCELHO"): "COMERCIALCONCEOeiras"[:14] + "Oeiras"}
    # ladders of different bases that lead to the same word, in one pass
    mixed = assigned(spark, [("1.1.0", "X", "SN"), ("2.1.0", "DOS MOTORISTAS", "SN"), ("3.1.0", "Y", "SNM"), ("4.1.0", "DOS MOTORISTAS", "SNM"), ("5.1.0", "Z", "SNMotoristas")])
    assert len({c.upper() for c in mixed.values()}) == 5 and mixed[("5.1", "SNMotoristas")] == "SNMotoristas"
    assert assigned(spark, [("7.1.0", "Empresa de Tecidos do Norte, SA", None)]) == {("7.1", "EmpresaTecidosNorte"): "EmpresaTecidosNorte"}


def test_chains_of_any_depth(spark):
    tree = spark.createDataFrame([(k, k - 1 if k > 1 else None, f"L{k}") for k in range(1, 20)] + [(50, 49, "lost parent"), (60, None, "alone")], "id int, up int, label string")
    got = dict(rows(lookup.parents(tree, "id", "up", "label"), "id", "chain"))
    assert got[19] == " > ".join(f"L{k}" for k in range(1, 19)) and got[1] == got[50] == got[60] == ""
    below = rows(lookup.descendants(tree, "id", "up", tree.filter("id in (1, 17)").select("id")), "root", "node")
    assert sorted(below) == sorted([("1", k) for k in range(2, 20)] + [("17", 18), ("17", 19)])
    with pytest.raises(ValueError):
        lookup.parents(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id int, up int, label string"), "id", "up", "label")


def test_previous_of_a_hot_key(spark):
    r = random.Random(4)
    data = [(r.choice(["a", "a", "b", None]), n) for n in r.sample(range(1000), 200)]
    got = {(x["k"], x["n"]): x["previous"] for x in lookup.previous_of(spark.createDataFrame(data, "k string, n int"), ["k"], "n", 64).collect()}
    assert got == {(k, n): max((m for j, m in data if j == k and m < n), default=None) for k, n in data}


def test_coverage_against_all_pairs(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(30)] + ["the"] * 20
    items = [(k, " ".join(r.choices(words, k=r.randint(0, 6)))) for k in range(40)]
    docs = [(k, " ".join(r.choices(words, k=r.randint(0, 15)))) for k in range(60)]
    split = F.filter(F.split("text", " "), lambda x: x != "")
    got = {i: (d, s) for i, d, s in rows(lookup.best_coverage(spark.createDataFrame(items, "i int, text string"), ["i"], split, spark.createDataFrame(docs, "d int, text string"), ["d"], split, 0.5), "i", "d", "share")}
    want = {}
    for i, text in items:
        own = set(text.split())
        best = min(((-len(own & set(t.split())) / len(own), d) for d, t in docs), default=None) if own else None
        if best and -best[0] >= 0.5:
            want[i] = (best[1], -best[0])
    assert got == want


def test_short_keys_and_prefixes(spark):
    names = spark.createDataFrame([("abcdefgh",), ("xy",), ("bcd",)], "name string")
    keys = spark.createDataFrame([("cd", "v", 1), ("bcdefg", "w", 2), ("y", "z", 3), ("q", "n", 4), ("", "e", 5)], "key string, value string, ord int")
    assert sorted(rows(lookup.contained_keys(names, "name", keys, 1), "name", "key")) == [("abcdefgh", "bcdefg"), ("abcdefgh", "cd"), ("bcd", "cd"), ("xy", "y")]
    left = spark.createDataFrame([("aa_bb",), ("aa_bb_cc",), ("aa_bbx",), ("aa",)], "doc string")
    right = spark.createDataFrame([("aa_bb", 1), ("aa", 2), ("aa_bb_cc_dd", 3)], "cut string, n int")
    assert sorted(rows(lookup.prefix_lookup(left, "doc", right, "cut", "n", 2), "doc", "cut")) == [("aa", "aa_bb"), ("aa_bb", "aa_bb"), ("aa_bb_cc", "aa_bb_cc_dd"), ("aa_bbx", "aa")]  # ties: the first in order
