"""What larger tables need: nothing is multiplied before it is dealt out, and both ways of a join give the same rows."""

import difflib
import random
import re

import duckdb

from lexspan.operators import diff, evaluation, geometry
from lexspan.plans import coding


def test_boxes_are_not_dealt_by_cell_where_a_page_has_few(spark):
    """A box of a page with few boxes has one row; pages with many still find every pair, by cells."""
    size = geometry.FEW + 4
    box = lambda p, k: (p, k, 10.0 * (k % 5), 7.0 * (k % 3), 10.0 * (k % 5) + 33, 7.0 * (k % 3) + 21)
    boxes = [box(1, k) for k in range(size)] + [box(2, k) for k in range(geometry.FEW)] + [box(3, 0)]
    points = [(p, 100 * p + k, 3.0 * k, 2.0 * k, 3.0 * k + 2, 2.0 * k + 2) for p in (1, 2, 3, 4) for k in range(30)]
    p = spark.createDataFrame(points, "page long, glyph_id long, x0 double, top double, x1 double, bottom double")
    b = spark.createDataFrame(boxes, "page long, box_id long, x0 double, top double, x1 double, bottom double")
    want = sorted((g[0], g[1], x[1]) for g in points for x in boxes if g[0] == x[0] and x[2] <= g[2] + 1 < x[4] and x[3] <= g[3] + 1 < x[5])
    found = geometry.inside(p, b, ["page"])
    assert sorted(map(tuple, found.collect())) == want and want
    lost = {(g[0], g[1]) for g in points} - {w[:2] for w in want}
    assert {(r["page"], r["glyph_id"]) for r in geometry.outside(p, b, ["page"]).collect()} == lost
    # by cells alone the side of the boxes would have several rows for each box of pages 2 and 3, and might be broadcast
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = geometry.inside(p, b, ["page"])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and sum("BroadcastHashJoin" in x and "__c" in x for x in plan.split("\n")) == 0


def test_segment_overlap_follows_its_sql_on_odd_white_space_and_letters(spark, tmp_path):
    texts = ["a b\u00a0c d", "a b c d", "word \u0085", "word", "\u2003x y", "x y", "İstanbul two three", "istanbul two three", "ΟΔΟΣ five six", "οδοσ five six", "tab\tand\x0bvt", "tab and vt", "", " "]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, coding.segment_overlap(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(coding.ORACLE_SQL["segment_overlap"]).fetchall()) and len(got) > 10


def test_ratios_end_early_and_are_difflibs_where_they_reach(spark):
    r = random.Random(3)
    for k in range(300):
        a = "".join(r.choice("abcd efgh") for _ in range(r.choice([0, 5, 40, 190, 230])))
        b = "".join(c if r.random() < r.choice([0.5, 0.9, 1.0]) else r.choice("abcdxyz") for c in a)
        want = difflib.SequenceMatcher(None, a, b).ratio()
        for least in (0.0, want, 0.5, 0.75):
            assert diff.ratio(a, b, least) == (want if want >= least else -1.0)
    far = "x" + "ab" * 80, "ab" * 10 + "y" * 140
    assert evaluation.matched(*far, need=150) == -1


def test_a_pair_of_versions_is_one_row_to_python(spark):
    """Not a group call for each pair, which took longer than most pairs' matching."""
    rows = [(p, k, f"c{k}", f"k{k}" if k % 3 else None, "", f"c{k}\nsome words {k * 7} of clause {k} in {p}") for p in range(5) for k in range(6)]
    new = spark.createDataFrame(rows, "p long, ord int, label string, key string, title string, text string")
    old = spark.createDataFrame([(p, k, c, key, t, x.replace("words 14", "other things 99")) for p, k, c, key, t, x in rows if p != 4], new.schema)
    out = diff.compare_versions(new, old, ["p"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    want = [(p, *m) for p in range(5) for m in diff.match_clauses([x[2:] for x in rows if x[0] == p], [x[2:5] + (x[5].replace("words 14", "other things 99"),) for x in rows if x[0] == p and p != 4])]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))


def test_page_loss_deals_texts_not_words(spark):
    pages = spark.createDataFrame([(1, 0, "a a b"), (1, 1, "a c"), (2, 0, "x"), (None, 0, "n"), (3, 0, None)], "d long, page int, text string")
    text = spark.createDataFrame([(1, "a c a"), (None, "n"), (2, None), (4, "z")], "d long, text string")
    out = evaluation.page_loss(pages, text, ["d"], "page")
    dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(dealt) == 1 and "word" not in dealt[0]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, 0, 3, 1, 1 / 3), (1, 1, 2, 1, 0.5), (2, 0, 1, 1, 1.0), (None, 0, 1, 1, 1.0)]))


def test_an_outline_is_one_row_from_end_to_end(spark):
    from lexspan.operators import structure

    docs = spark.createDataFrame([(1, "Acordo\nCAPÍTULO I\nÂmbito\nCláusula 1.ª\nÁrea\n1- Um.\nPela Empresa:"), (1, "Texto."), (None, None)], "doc_id int, text string")
    plan = structure.structure(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Sort", "Generate")), plan
    got = [(r["doc_id"], r["type"], r["label"], r["parent"]) for r in structure.node_rows(docs).collect()]
    assert got == [(1, "preamble", "PREAMBLE", ""), (1, "chapter", "CAPÍTULO I - Âmbito", ""), (1, "clause", "Cláusula 1.ª - Área", "CAPÍTULO I - Âmbito"), (1, "block", "SIGNATURES", ""), (1, "paragraph", "1- Um.", "Cláusula 1.ª - Área"), (1, "preamble", "PREAMBLE", "")]
    spans = [r["spans"] for r in structure.leaf_spans(docs).collect()]
    assert ["".join(x) for x in spans] == [r["text"] for r in structure.structure(docs).collect()] and [len(x) for x in spans] == [4, 1, 0]


def test_matching_blocks_by_runs_that_are_counted_once(spark, tmp_path, monkeypatch):
    from lexspan.plans import texts

    r = random.Random(5)
    monkeypatch.setattr(evaluation, "FEW_PAIRS", 1)
    for k in range(150):
        letters = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz0123456789"])
        a = "".join(r.choices(letters, k=r.choice([0, 3, 40, 250])))
        b = a[: len(a) // 3] + "".join(r.choices(letters, k=r.choice([0, 5, 210]))) + a[len(a) // 2 :]
        for junk in (True, False):
            want = sum(x.size for x in difflib.SequenceMatcher(None, a, b, junk).get_matching_blocks())
            assert evaluation.matched(a, b, junk) == want
            assert evaluation.matched(a, b, junk, need=want + 1) == -1
            monkeypatch.setattr(evaluation, "MANY_PAIRS", 0 if k % 2 else 2_000_000)  # the way for more pairs than are held
    spark.createDataFrame([(k, "en", "web", f"text {k} of a source") for k in range(50)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = texts.order_ratio(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "MapInPandas" in plan


def test_overlapping_deals_words_without_their_lines(spark):
    lines = [(k, f"{'line' if k % 3 else 'x'} number {k % 7} of some text that is long enough to overlap {k % 4}"[: 10 + 4 * (k % 20)]) for k in range(120)] + [(200, ""), (201, "x")]
    texts = ["x number 1 of some text that is long enough to overlap", "xnumber", "of some", "a line number 2 of some text that is long enough to overlap 2 and more", "x", "", "nothing here at all"]
    items, rows = spark.createDataFrame(list(enumerate(texts)), "item int, seg string"), spark.createDataFrame(lines, "row int, body string")
    found = evaluation.overlapping(items, "item", "seg", rows, ["row"], "body")
    start = lambda t: t[: max(40, len(t) // 3)]
    meet = lambda x, y: bool(x and y) and (x in y or y in x or start(min(x, y, key=len)) in max(y, x, key=len))
    want = sorted((i, k) for i, x in enumerate(texts) for k, y in lines if meet(x, y))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    # whatever makes words of a line leaves the line behind at once
    above = [plan[k - 1] for k, x in enumerate(plan) if "Generate explode" in x and "[body#" in x]
    assert all("Project [" in x and not re.search(r"[\[ ]body#", x) for x in above), above
