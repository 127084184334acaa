"""Queries of page geometry, page furniture and upkeep checks: line items as glyphs and boxes of pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import geometry, lines, sanity, upkeep
from .common import table

PAGE = ["page"]


def _number():
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def glyphs(spark, sf_dir):
    """Line items as glyphs of their order's page."""
    rows = table(spark, sf_dir, "lineitem").withColumn("glyph_id", _number())
    x0, top = (F.col("l_partkey") % 300 - 20).cast("double"), (F.col("l_linenumber") * 7 + F.col("l_partkey") % 5).cast("double")
    return rows.select(F.col("l_orderkey").alias("page"), "glyph_id", F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.chr(97 + F.col("l_suppkey") % 26)).alias("text"), x0.alias("x0"), top.alias("top"), (x0 + 1 + F.col("l_suppkey") % 8).alias("x1"), (top + 8).alias("bottom"), (F.col("l_suppkey") % 3).cast("int").alias("font"), F.when(F.col("l_partkey") % 3 == 0, "upright").when(F.col("l_partkey") % 3 == 1, "left").otherwise("half").alias("direction"))


def boxes(spark, sf_dir):
    """Line items as boxes."""
    rows = table(spark, sf_dir, "lineitem").withColumn("box_id", _number())
    x0, top = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    return rows.select(F.col("l_orderkey").alias("page"), "box_id", x0.alias("x0"), top.alias("top"), (x0 + 5 + F.col("l_partkey") % 37).alias("x1"), (top + 4 + F.col("l_suppkey") % 31).alias("bottom"))


def visible_glyphs(spark, sf_dir):
    return geometry.on_page(glyphs(spark, sf_dir), F.lit(250.0), F.lit(45.0)).groupBy("page").agg(F.count("*").alias("n"), F.sum("glyph_id").cast("long").alias("ids"))


def shown_glyphs(spark, sf_dir):
    """Glyphs without those that a hidden one of the same text, a twentieth of a point away, covers."""
    g = glyphs(spark, sf_dir)
    hidden = g.filter("glyph_id % 3 = 0").select("page", F.when(F.col("glyph_id") % 2 == 0, F.col("text")).otherwise("?").alias("text"), (F.col("x0") + 0.05).alias("x0"), (F.col("top") - F.when(F.col("font") == 0, 0.2).otherwise(0.05)).alias("top"))
    return geometry.without_hidden(g, hidden, PAGE).select("page", "glyph_id")


def drawn_spaces(spark, sf_dir):
    return geometry.without_covered_spaces(glyphs(spark, sf_dir), PAGE).groupBy("page").agg(F.count("*").alias("n"))


def page_directions(spark, sf_dir):
    return geometry.direction(glyphs(spark, sf_dir), PAGE, 2)


def glyph_lines(spark, sf_dir):
    return geometry.text_lines(glyphs(spark, sf_dir), PAGE).select("page", "line_no", "top", "line")


def line_tolerances(spark, sf_dir):
    return geometry.line_gaps(glyphs(spark, sf_dir), PAGE)


def column_pages(spark, sf_dir):
    """Suppliers as pages of words in two columns; some have words across the middle."""
    x0 = (F.col("l_partkey") % 2 * 300 + F.col("l_partkey") % 100).cast("double")
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x0.alias("x0"), (x0 + F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_partkey") % 2 == 0), 250).otherwise(40)).alias("x1"))
    return geometry.two_columns(words, PAGE, F.lit(500.0))


def box_columns(spark, sf_dir):
    x0 = (F.col("l_partkey") % 2 * 300 + F.col("l_partkey") % 100).cast("double")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x0.alias("x0"), (x0 + F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_partkey") % 8 == 0), 250).otherwise(40)).alias("x1"))
    return geometry.columns_of_boxes(b, PAGE, F.lit(500.0))


def _order_boxes(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("box_id"), (c % 200).cast("double").alias("x0"), (c % 40).cast("double").alias("top"), (c % 200 + 60).cast("double").alias("x1"), (c % 40 + 25).cast("double").alias("bottom"))


def glyphs_in_boxes(spark, sf_dir):
    return geometry.inside(glyphs(spark, sf_dir), _order_boxes(spark, sf_dir), PAGE)


def glyphs_outside(spark, sf_dir):
    return geometry.outside(glyphs(spark, sf_dir), _order_boxes(spark, sf_dir), PAGE).groupBy("page").agg(F.count("*").alias("n"))


def nested_boxes(spark, sf_dir):
    return geometry.nested_boxes(boxes(spark, sf_dir), PAGE)


def tall_boxes(spark, sf_dir):
    return geometry.tall_boxes(boxes(spark, sf_dir)).select("page", "box_id")


def image_pages(spark, sf_dir):
    return geometry.image_pages(boxes(spark, sf_dir), PAGE, F.lit(10000.0))


def crossed_pages(spark, sf_dir):
    """Pages that strokes or boxes cross in the middle."""
    b = boxes(spark, sf_dir)
    strokes = geometry.strokes_across(b, PAGE, F.lit(40.0), F.lit(60.0)).withColumn("by", F.lit("strokes"))
    return strokes.unionByName(geometry.tables_across(b, PAGE, F.lit(40.0)).withColumn("by", F.lit("box")))


def column_bands(spark, sf_dir):
    return geometry.bands(glyphs(spark, sf_dir).withColumn("top", F.col("top") * 10 + F.col("glyph_id")).withColumn("bottom", F.col("top") + 8).withColumn("x1", F.col("x0") + F.when(F.col("font") == 0, 200).otherwise(5)), PAGE, F.lit(120.0)).select("page", "glyph_id", "full", "band")


def gap_runs(spark, sf_dir):
    out = geometry.gap_runs_on(glyphs(spark, sf_dir).withColumn("x0", F.col("x0") + F.col("glyph_id") / 16).withColumn("x1", F.col("x0") + 1), PAGE, F.lit(120.0))
    return out.select("page", F.coalesce("runs_on", F.lit(False)).alias("runs_on"))


def turned_areas(spark, sf_dir):
    return geometry.turned_majority(glyphs(spark, sf_dir), PAGE)


def reading_keys(spark, sf_dir):
    """Glyphs in the order of reading, those turned half round last."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy("order_key", "glyph_id"))
    return geometry.upside_down_last(glyphs(spark, sf_dir)).select("page", "glyph_id", rank.alias("place"))


def item_order(spark, sf_dir):
    """Line items of a document; every third has no place and follows the one before."""
    gone = F.col("glyph_id") % 3 == 0
    items = glyphs(spark, sf_dir).select(F.col("page").alias("doc"), F.col("glyph_id").alias("item_no"), *[F.when(~gone, c).alias(n) for n, c in (("page", F.col("font")), ("column", (F.col("x0") > 120).cast("int")), ("top", F.col("top")))])
    return geometry.reading_order(items, ["doc"]).select("doc", "item_no", "order")


def _cells(spark, sf_dir):
    g = glyphs(spark, sf_dir)
    return g.select("page", F.ceil(F.col("glyph_id") / 2).cast("int").alias("row_no"), ((F.col("glyph_id") - 1) % 2 + 1).cast("int").alias("column_no"), F.when(F.col("font") > 0, F.concat(F.lit(" "), "text", F.lit("x-\n y\n"))).alias("text"), "font")


def cell_tables(spark, sf_dir):
    """Cells of each page as rows of text, tables of even pages turned over."""
    return geometry.table_text(geometry.transposed(_cells(spark, sf_dir), F.col("page") % 2 == 0), PAGE)


def cell_rows(spark, sf_dir):
    """Rows with their cells' words joined over line breaks."""
    rows = _cells(spark, sf_dir).groupBy("page", "row_no").agg(F.array_sort(F.collect_list(F.struct("column_no", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    return rows.select("page", "row_no", lines.table_row(F.transform("x", lambda c: c["t"])).alias("line"))


def first_cells(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("span_row", F.when(F.col("font") == 0, F.col("row_no") - 1).otherwise(F.col("row_no"))).withColumn("span_column", F.col("column_no"))
    return geometry.span_cells(c, PAGE).groupBy("page").agg(F.count("*").alias("n"))


def page_texts(spark, sf_dir):
    g = glyphs(spark, sf_dir)
    parts = g.select("page", (F.col("glyph_id") % 2).alias("band"), F.col("font").alias("column"), F.col("glyph_id").alias("top"), F.concat("text", F.col("glyph_id")).alias("text"))
    return geometry.page_text(parts, PAGE, "|")


def admitted_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("length"), (F.col("page_id") % 700).alias("n_pages"))
    good, bad = geometry.admitted(files, 1500, 500)
    return bad.select("reason").unionByName(good.select(F.lit("admitted").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


LINES = ["Boletim do Trabalho e Emprego, n.º 31, 22/8/2026", "22 agosto 2026", "BTE 31 | 34", "BTE | 100", "artigo 3.º", "17", "Boletim do Trabalho e Emprego 31 22 agosto 2026 Deve ler-se", "fim Boletim do Trabalho e Emprego 28 29 agosto 2025 x", "BTE 3 | 4 e mais"]


def furniture_forms(spark, sf_dir):
    """Lines made of furniture forms and numbers: which are furniture, which leave a residue, and what stays of them."""
    line = F.concat(F.element_at(F.array(*[F.lit(x) for x in LINES]), (F.col("l_partkey") % len(LINES) + 1).cast("int")), F.when(F.col("l_suppkey") % 5 == 0, " ").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").groupBy(line.alias("line")).agg(F.count("*").alias("n"))
    return rows.select("line", sanity.is_furniture("line").alias("furniture"), sanity.margin_furniture("line").alias("margin"), sanity.has_residue("line").alias("residue"), F.trim(sanity.without_header_prefix("line")).alias("rest"), "n")


def clean_pages(spark, sf_dir):
    """Pages of such lines, cleaned: lines kept by page."""
    line = F.element_at(F.array(*[F.lit(x) for x in LINES]), (F.col("l_partkey") % len(LINES) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), _number().alias("line_no"), line.alias("line"))
    return sanity.clean_page(rows, PAGE).groupBy("page").agg(F.count_if(~F.col("removed")).alias("kept"), F.count("*").alias("n"))


def column_segments(spark, sf_dir):
    rows = glyphs(spark, sf_dir).select("page", F.col("glyph_id").alias("line_no"), F.when(F.col("font") == 0, lines.COLUMN_MARK).otherwise(F.col("text")).alias("line"))
    return lines.column_segments(rows, PAGE).select("page", "line_no", "segment_no")


def joined_hyphens(spark, sf_dir):
    """Documents with every n before a blank made a word split over lines, and cleaned."""
    text = F.replace(F.replace("text", F.lit("n "), F.lit("n-\n")), F.lit("t "), F.lit("t  \n\n\n\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.md5(lines.join_hyphens("text")).alias("md5"))


def clean_items(spark, sf_dir):
    text = F.concat(F.lit(" "), F.replace("text", F.lit("n"), F.lit("­n­ \n ")), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(geometry.clean_item(text), F.lit("none"))).alias("md5"))


def camel_tokens(spark, sf_dir):
    """Parts of camel-case tokens made of part names, and identifiers' numbers of several forms."""
    token = F.concat(F.initcap("p_brand"), F.upper("p_type"), F.col("p_partkey"), F.lit("fooBar"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(token, "[^A-Za-z0-9]", "").alias("token"))
    return parts.select("p_partkey", F.array_join(fx.camel_parts("token"), "|").alias("parts"))


def yearly_numbers(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), F.col("o_orderkey"), F.lit("/2025 "))).when(F.col("o_orderkey") % 4 == 1, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("n"), F.col("o_orderkey"))).otherwise("1234567")
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.yearly_number(raw).alias("number"))


def url_checks(spark, sf_dir):
    """Pages' addresses changed to hosts of three kinds: which may be asked, which are this machine."""
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.concat(F.lit("https://good.example/"), "page_id")).when(k == 1, "http://good.example/x").when(k == 2, "http://localhost:1234/v1").when(k == 3, "https://127.0.0.1/a").when(k == 4, "http://me:pw@localhost/a").otherwise("https://GOOD.example/q?x=1")
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("u"))
    return rows.select("page_id", upkeep.allowed_url("u", ["good.example"]).alias("allowed"), upkeep.local_url("u").alias("local"))


def issue_paths(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", upkeep.issue_path(F.year("o_orderdate"), F.weekofyear("o_orderdate")).alias("path"))


def grouped_warnings(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation "), "s_nationkey").alias("w"), F.col("s_name"))
    return upkeep.grouped_warning(rows, "w", "s_name")


def model_benches(spark, sf_dir):
    """Events as answers of models: the value's parity is expected, its thirds answered, some can't be read."""
    e = table(spark, sf_dir, "events")
    answers = e.select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "1.1").alias("expected"), F.when(F.col("user_id") % 7 == 0, "!").when(F.col("user_id") % 3 == 0, "1.1").when(F.col("user_id") % 5 == 0, "2.2").alias("got"), (F.col("user_id") % 10).cast("double").alias("seconds"))
    return upkeep.model_bench(answers).withColumn("mean_latency", F.round("mean_latency", 6))


def over_budget(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("value"), F.lit(5000.0).alias("limit"), (F.col("c_nationkey") % 2 == 0).alias("approved"))
    return upkeep.over_budget(m.select("name", "value"), m.select("name", "limit", "approved")).select("name")


def contract_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return upkeep.contract_violations(c, ["name"], {"segment": ["BUILDING", "MACHINERY"]}, {"balance": 0.0}).select("c_custkey", F.array_join("problems", "; ").alias("problems"))


def broken_links(spark, sf_dir):
    """Suppliers as pages with links to their nation's page, a third of them with a wrong name."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a/b/s"), "s_suppkey", F.lit(".md")).alias("path"), F.concat(F.lit("see [n](../n"), F.col("s_nationkey"), F.lit(".md#x) and [m](./"), F.when(F.col("s_suppkey") % 3 == 0, "S").otherwise("s"), F.col("s_suppkey"), F.lit(".md) [w](https://x/y)")).alias("text"))
    files = s.select("path").unionByName(table(spark, sf_dir, "nation").filter("n_nationkey % 5 > 0").select(F.concat(F.lit("a/n"), "n_nationkey", F.lit(".md")).alias("path")))
    return upkeep.broken_links(s, files)


QUERIES = {f.__name__: f for f in (
    visible_glyphs, shown_glyphs, drawn_spaces, page_directions, glyph_lines, line_tolerances, column_pages, box_columns, glyphs_in_boxes, glyphs_outside, nested_boxes, tall_boxes, image_pages, crossed_pages, column_bands, gap_runs,
    turned_areas, reading_keys, item_order, cell_tables, cell_rows, first_cells, page_texts, admitted_files, furniture_forms, clean_pages, column_segments, joined_hyphens, clean_items, camel_tokens, yearly_numbers, url_checks, issue_paths,
    grouped_warnings, model_benches, over_budget, contract_violations, broken_links,
)}

_N = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER)"
_G = f"""r AS (SELECT *, {_N} AS k FROM lineitem), g AS (SELECT l_orderkey AS page, k AS glyph_id, CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE chr(CAST(97 + l_suppkey % 26 AS INTEGER)) END AS text, CAST(l_partkey % 300 - 20 AS DOUBLE) AS x0, CAST(l_linenumber * 7 + l_partkey % 5 AS DOUBLE) AS top,
CAST(l_partkey % 300 - 19 + l_suppkey % 8 AS DOUBLE) AS x1, CAST(l_linenumber * 7 + l_partkey % 5 + 8 AS DOUBLE) AS bottom, CAST(l_suppkey % 3 AS INTEGER) AS font, ['upright', 'left', 'half'][l_partkey % 3 + 1] AS direction FROM r)"""
_B = f"""b AS (SELECT l_orderkey AS page, {_N} AS box_id, CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(l_suppkey % 20 AS DOUBLE) AS top, CAST(l_partkey % 50 + 5 + l_partkey % 37 AS DOUBLE) AS x1, CAST(l_suppkey % 20 + 4 + l_suppkey % 31 AS DOUBLE) AS bottom FROM lineitem)"""
_IN = "i AS (SELECT page, glyph_id FROM g JOIN orders ON o_orderkey = page WHERE (x0 + x1) / 2 >= o_custkey % 200 AND (x0 + x1) / 2 < o_custkey % 200 + 60 AND (top + bottom) / 2 >= o_custkey % 40 AND (top + bottom) / 2 < o_custkey % 40 + 25)"
_C = f"{_G}, c AS (SELECT page, CAST((glyph_id + 1) // 2 AS INTEGER) AS row_no, CAST((glyph_id - 1) % 2 + 1 AS INTEGER) AS column_no, CASE WHEN font > 0 THEN ' ' || text || 'x-' || chr(10) || ' y' || chr(10) END AS text, font FROM g)"
_LINE = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LINES) + f"][l_partkey % {len(LINES)} + 1]"
_MONTH = "(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"
_FURNITURE = f"(regexp_matches(trim(line), '(?i)^Boletim do Trabalho e Emprego,?\\s*(?:n\\.?\\s*º\\s*)?\\d+(?:,\\s*\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})?$') OR regexp_matches(trim(line), '(?i)^\\d{{1,2}}\\s+{_MONTH}\\s+\\d{{4}}$') OR regexp_matches(trim(line), '^BTE(?:\\s+\\d+(?:\\s*\\|\\s*\\d+)?|\\s*\\|\\s*\\d+)$'))"
_MARGIN = "(regexp_matches(trim(line), '^\\d{1,4}$') OR regexp_matches(trim(line), '^(?:BTE\\s*)?\\d{0,3}\\s*\\|\\s*\\d{1,4}$'))"

ORACLE_SQL = {
    "visible_glyphs": f"WITH {_G} SELECT page, count(*) AS n, CAST(sum(glyph_id) AS BIGINT) AS ids FROM g WHERE x1 > 0 AND x0 < 250 AND bottom > 0 AND top < 45 GROUP BY page",
    "shown_glyphs": f"WITH {_G}, h AS (SELECT page, CASE WHEN glyph_id % 2 = 0 THEN text ELSE '?' END AS text, x0, top, font FROM g WHERE glyph_id % 3 = 0 AND font > 0) SELECT page, glyph_id FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page = g.page AND h.text = g.text AND h.x0 = g.x0 AND h.top = g.top)",
    "drawn_spaces": f"WITH {_G} SELECT page, count(*) AS n FROM g WHERE NOT (text = ' ' AND EXISTS (SELECT 1 FROM g l WHERE l.page = g.page AND l.text <> ' ' AND l.bottom = g.bottom AND l.font <> g.font AND least(l.x1, g.x1) - greatest(l.x0, g.x0) > (g.x1 - g.x0) / 2)) GROUP BY page",
    "page_directions": f"WITH {_G}, t AS (SELECT page, direction, count(*) AS n FROM g GROUP BY ALL) SELECT page, CASE WHEN direction = 'upright' OR n >= 2 THEN direction ELSE 'upright' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, direction DESC) AS k FROM t) x WHERE k = 1",
    "glyph_lines": f"""WITH {_G}, d AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY page ORDER BY top, x0, glyph_id) > 3 THEN 1 ELSE 0 END AS new_ FROM g), e AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY top, x0, glyph_id) + 1 AS line_no FROM d),
f AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, line_no ORDER BY x0, glyph_id) > 2 THEN ' ' ELSE '' END || text AS s FROM e) SELECT page, CAST(line_no AS BIGINT) AS line_no, min(top) AS top, string_agg(s, '' ORDER BY x0, glyph_id) AS line FROM f GROUP BY page, line_no""",
    "line_tolerances": f"WITH {_G}, d AS (SELECT page, top - lag(top) OVER (PARTITION BY page ORDER BY top) AS gap FROM g) SELECT page, least(3.0::DOUBLE, min(gap) / 2) AS tolerance FROM d WHERE gap > 0 GROUP BY page",
    "column_pages": "WITH w AS (SELECT l_suppkey AS page, l_partkey % 2 * 300 + l_partkey % 100 AS x0, CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 2 = 0 THEN 250 ELSE 40 END AS wide FROM lineitem) SELECT page, 250.0::DOUBLE AS gutter FROM w GROUP BY page HAVING count(*) >= 40 AND count(*) FILTER (WHERE x0 < 250 AND x0 + wide > 250) < 0.02 * count(*) AND count(*) FILTER (WHERE x0 + wide <= 250) >= 0.25 * count(*) AND count(*) FILTER (WHERE x0 >= 250) >= 0.25 * count(*)",
    "box_columns": "WITH w AS (SELECT l_suppkey AS page, l_partkey % 2 * 300 + l_partkey % 100 AS x0, CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 8 = 0 THEN 250 ELSE 40 END AS wide FROM lineitem) SELECT page FROM w GROUP BY page HAVING count(*) >= 8 AND count(*) FILTER (WHERE x0 < 250 AND x0 + wide > 250) < 0.05 * count(*) AND count(*) FILTER (WHERE x0 + wide <= 250) >= 0.25 * count(*) AND count(*) FILTER (WHERE x0 >= 250) >= 0.25 * count(*)",
    "glyphs_in_boxes": f"WITH {_G}, {_IN} SELECT page, glyph_id, CAST(1 AS INTEGER) AS box_id FROM i",
    "glyphs_outside": f"WITH {_G}, {_IN} SELECT page, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.page = g.page AND i.glyph_id = g.glyph_id) GROUP BY page",
    "nested_boxes": f"""WITH {_B}, s AS (SELECT *, (x1 - x0) * (bottom - top) AS area FROM b) SELECT a.page, a.box_id, o.box_id AS outer_id FROM s a JOIN s o ON a.page = o.page AND a.box_id <> o.box_id
WHERE a.area < o.area AND greatest(least(a.x1, o.x1) - greatest(a.x0, o.x0), 0) * greatest(least(a.bottom, o.bottom) - greatest(a.top, o.top), 0) >= 0.9::DOUBLE * a.area""",
    "tall_boxes": f"WITH {_B} SELECT page, box_id FROM b WHERE bottom - top > 2 * (x1 - x0)",
    "image_pages": f"WITH {_B} SELECT DISTINCT page FROM b WHERE (x1 - x0) * (bottom - top) >= 0.03::DOUBLE * 10000",
    "crossed_pages": f"WITH {_B}, x AS (SELECT * FROM b WHERE x0 < 40 AND x1 > 40) SELECT page, 'strokes' AS by FROM x WHERE top > 6 AND bottom < 54 GROUP BY page HAVING count(*) >= 2 UNION ALL SELECT DISTINCT page, 'box' FROM x",
    "column_bands": f"""WITH {_G}, s AS (SELECT page, glyph_id, x0, top * 10 + glyph_id AS top, x0 < 120 AND x0 + CASE WHEN font = 0 THEN 200 ELSE 5 END > 120 AS "full" FROM g),
t AS (SELECT *, lag("full") OVER w AS f, lag(top + 8) OVER w AS b FROM s WINDOW w AS (PARTITION BY page ORDER BY top, x0)) SELECT page, glyph_id, "full", CAST(sum(CASE WHEN f <> "full" OR top - b >= 24 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, x0) AS BIGINT) AS band FROM t""",
    "gap_runs": f"""WITH {_G}, s AS (SELECT page, x0 + glyph_id / 16.0::DOUBLE AS x0 FROM g), t AS (SELECT page, x0, lag(x0 + 1) OVER (PARTITION BY page ORDER BY x0) AS p FROM s), u AS (SELECT page, x0 - p AS gap, p <= 120 AND x0 >= 120 AS over_ FROM t WHERE p IS NOT NULL)
SELECT page, coalesce(max(gap) FILTER (WHERE over_) <= 1.2::DOUBLE * coalesce(max(gap) FILTER (WHERE NOT over_), 0), false) AS runs_on FROM u GROUP BY page""",
    "turned_areas": f"WITH {_G} SELECT page, count(*) FILTER (WHERE direction <> 'upright') * 2 > count(*) AS turned FROM g GROUP BY page",
    "reading_keys": f"WITH {_G} SELECT page, glyph_id, CAST(row_number() OVER (PARTITION BY page ORDER BY direction = 'half', CASE WHEN direction = 'half' THEN -bottom ELSE top END, CASE WHEN direction = 'half' THEN -x1 ELSE x0 END, glyph_id) AS INTEGER) AS place FROM g",
    "item_order": f"""WITH {_G}, s AS (SELECT page AS doc, glyph_id AS item_no, CASE WHEN glyph_id % 3 > 0 THEN font END AS p, CASE WHEN x0 > 120 THEN 1 ELSE 0 END AS c, top FROM g),
t AS (SELECT *, max(CASE WHEN p IS NOT NULL THEN item_no END) OVER (PARTITION BY doc ORDER BY item_no) AS at FROM s), u AS (SELECT t.doc, t.item_no, o.p, o.c, o.top FROM t LEFT JOIN s o ON o.doc = t.doc AND o.item_no = t.at)
SELECT doc, item_no, CAST(row_number() OVER (PARTITION BY doc ORDER BY p NULLS FIRST, c, top, item_no) AS INTEGER) AS "order" FROM u""",
    "cell_tables": f"""WITH {_C}, t AS (SELECT page, CASE WHEN page % 2 = 0 THEN column_no ELSE row_no END AS row_no, CASE WHEN page % 2 = 0 THEN row_no ELSE column_no END AS column_no, trim(coalesce(text, ''), ' ') AS t FROM c)
SELECT page, row_no, string_agg(t, ' | ' ORDER BY column_no) AS line FROM t GROUP BY page, row_no HAVING bool_or(t <> '')""",
    "cell_rows": f"WITH {_C} SELECT page, row_no, string_agg(CASE WHEN text IS NULL THEN '' ELSE trim(substr(text, 2, 1) || 'xy') END, ' | ' ORDER BY column_no) AS line FROM c GROUP BY page, row_no",
    "first_cells": f"WITH {_C} SELECT page, count(*) AS n FROM c WHERE font > 0 GROUP BY page",
    "page_texts": f"""WITH {_G}, s AS (SELECT page, glyph_id % 2 AS band, font, glyph_id, text || glyph_id AS t FROM g), m AS (SELECT *, CASE WHEN lag(band) OVER w = band AND lag(font) OVER w <> font THEN '|' || chr(10) ELSE '' END || t AS u FROM s WINDOW w AS (PARTITION BY page ORDER BY band, font, glyph_id))
SELECT page, string_agg(u, chr(10) ORDER BY band, font, glyph_id) AS text FROM m GROUP BY page""",
    "admitted_files": "SELECT CASE WHEN octet_length(encode(coalesce(html, ''))) > 1500 THEN 'too large' WHEN page_id % 700 > 500 THEN 'too many pages' ELSE 'admitted' END AS reason, count(*) AS n FROM pages GROUP BY 1",
    "furniture_forms": f"""WITH l AS (SELECT {_LINE} || CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE '' END AS line, count(*) AS n FROM lineitem GROUP BY 1)
SELECT line, {_FURNITURE} AS furniture, {_MARGIN} AS margin, {_FURNITURE} OR regexp_matches(line, 'Boletim do Trabalho e Emprego \\d+(?:[^\\d,]|$)|\\bBTE \\d+ \\| \\d+\\b') AS residue,
trim(regexp_replace(trim(line), '(?i)^Boletim do Trabalho e Emprego\\s+\\d+(?:\\s+\\d{{1,2}}\\s+{_MONTH}\\s+\\d(?:\\s?\\d){{3}})?(?:\\s+|$)', '')) AS rest, n FROM l""",
    "clean_pages": f"""WITH l AS (SELECT l_orderkey AS page, {_N} AS line_no, {_LINE} AS line FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM l)
SELECT page, count(*) FILTER (WHERE NOT ({_FURNITURE} OR ((line_no <= 2 OR line_no > n - 2) AND {_MARGIN}))) AS kept, count(*) AS n FROM k GROUP BY page""",
    "column_segments": f"WITH {_G} SELECT page, glyph_id AS line_no, seg AS segment_no FROM (SELECT *, CAST(count(*) FILTER (WHERE font = 0) OVER (PARTITION BY page ORDER BY glyph_id) AS BIGINT) AS seg FROM g) x WHERE font > 0",
    "joined_hyphens": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'n ', 'n-' || chr(10)), 't ', 't  ' || repeat(chr(10), 4)), '-\n([a-zà-ÿ])', '\1', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS md5 FROM documents",
    "clean_items": r"SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(regexp_replace(' ' || replace(text, 'n', chr(173) || 'n' || chr(173) || ' ' || chr(10) || ' ') || ' ', '\x{AD}\s*\n\s*', '', 'g'), '\x{AD}', '', 'g'), ' '), ''), 'none')) AS md5 FROM documents",
    "camel_tokens": r"SELECT p_partkey, array_to_string(list_filter([regexp_replace(upper(left(p_brand, 1)) || lower(substr(p_brand, 2, 4)), '[^A-Za-z]', '', 'g'), regexp_replace(p_brand, '[^0-9]', '', 'g'), regexp_replace(upper(p_type), '[^A-Z]', '', 'g'), CAST(p_partkey AS VARCHAR), 'foo', 'Bar'], lambda x: x <> ''), '|') AS parts FROM part",
    "yearly_numbers": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey < 1000000 THEN o_orderkey WHEN o_orderkey % 4 = 1 AND o_custkey < 1000000 THEN o_custkey END AS INTEGER) AS number FROM orders",
    "url_checks": "SELECT page_id, page_id % 6 IN (0, 5) AS allowed, page_id % 6 IN (2, 3) AS local FROM pages",
    "issue_paths": "SELECT o_orderkey, printf('%d/BTE_%02d_%d.pdf', year(o_orderdate), week(o_orderdate), year(o_orderdate)) AS path FROM orders",
    "grouped_warnings": "SELECT 'nation ' || s_nationkey AS warning, count(*) AS n, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS items FROM supplier GROUP BY s_nationkey",
    "model_benches": """WITH a AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN '1.1' END AS e, CASE WHEN user_id % 7 = 0 THEN '!' WHEN user_id % 3 = 0 THEN '1.1' WHEN user_id % 5 = 0 THEN '2.2' END AS g, user_id % 10 AS s FROM events)
SELECT model, count(*) FILTER (WHERE g IS DISTINCT FROM '!' AND e IS NOT DISTINCT FROM g) AS hits, count(*) FILTER (WHERE g IS NOT NULL AND g <> '!' AND e IS DISTINCT FROM g) AS false_positives, count(*) FILTER (WHERE g IS DISTINCT FROM '!' AND e IS NOT NULL AND e IS DISTINCT FROM g) AS false_negatives, count(*) FILTER (WHERE g = '!') AS invalid, round(avg(s), 6) AS mean_latency FROM a GROUP BY model""",
    "over_budget": "SELECT c_name AS name FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal > 5000",
    "contract_violations": "WITH p AS (SELECT c_custkey, list_filter([CASE WHEN c_nationkey % 4 = 0 THEN 'name missing' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment unknown' END, CASE WHEN c_acctbal < 0 THEN 'balance too small' END], lambda x: x IS NOT NULL) AS x FROM customer) SELECT c_custkey, array_to_string(x, '; ') AS problems FROM p WHERE len(x) > 0",
    "broken_links": "SELECT 'a/b/s' || s_suppkey || '.md' AS path, '../n' || s_nationkey || '.md' AS target FROM supplier WHERE s_nationkey % 5 = 0 UNION ALL SELECT 'a/b/s' || s_suppkey || '.md', './S' || s_suppkey || '.md' FROM supplier WHERE s_suppkey % 3 = 0",
}
