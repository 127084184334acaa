"""Page geometry as relations: glyphs, lines, boxes. Inputs are tables that a PDF reader supplies; every operator is native.

A glyph is (page…, glyph_id, text, x0, top, x1, bottom); a box (page…, box_id, x0, top, x1, bottom).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 16.0
#: Boxes of a page that all its glyphs are compared with.
FEW = 16


def near_cells(*at: Column, size: float = CELL) -> Column:
    """Grid cells around a point, for a bucketed range join: its own and its neighbours."""
    side = F.array(F.lit(-1), F.lit(0), F.lit(1))
    x, y = (F.floor(c / size) for c in at)
    return F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: F.struct((x + i).alias("cx"), (y + j).alias("cy")))))


def cells(x0: Column, top: Column, x1: Column, bottom: Column, size: float = CELL) -> Column:
    """All grid cells that a box touches."""
    return F.flatten(F.transform(F.sequence(F.floor(x0 / size), F.floor(x1 / size)), lambda i: F.transform(F.sequence(F.floor(top / size), F.floor(bottom / size)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def on_page(glyphs: DataFrame, width: Column, height: Column) -> DataFrame:
    """Glyphs that lie on their page."""
    return glyphs.filter((F.col("x1") > 0) & (F.col("x0") < width) & (F.col("bottom") > 0) & (F.col("top") < height))


def without_hidden(glyphs: DataFrame, hidden: DataFrame, page: list[str], tolerance: float = 0.1) -> DataFrame:
    """Glyphs that no hidden glyph of the same text and origin, within the tolerance, matches."""
    h = hidden.select(*page, F.col("text").alias("__t"), F.col("x0").alias("__x"), F.col("top").alias("__y")).withColumn("__c", F.explode(near_cells(F.col("__x"), F.col("__y"), size=1.0)))
    g = glyphs.withColumn("__c", F.struct(F.floor("x0").alias("cx"), F.floor("top").alias("cy")))
    hit = g.join(h, [*page, "__c"]).filter((F.col("text") == F.col("__t")) & (F.abs(F.col("x0") - F.col("__x")) <= tolerance) & (F.abs(F.col("top") - F.col("__y")) <= tolerance)).select(*page, "glyph_id").distinct()
    return glyphs.join(hit, [*page, "glyph_id"], "left_anti")


def without_covered_spaces(glyphs: DataFrame, page: list[str]) -> DataFrame:
    """Spaces of another font that are drawn over more than half of a letter on the same line go."""
    letters = glyphs.filter("trim(text) <> ''").select(*page, F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), F.col("bottom").alias("lb"), F.col("font").alias("lf")).withColumn("__r", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("lb") / 4) + d)))
    spaces = glyphs.filter("trim(text) = ''").withColumn("__r", F.floor(F.col("bottom") / 4))
    over = F.least("x1", "lx1") - F.greatest("x0", "lx0")
    gone = spaces.join(letters, [*page, "__r"]).filter((F.abs(F.col("bottom") - F.col("lb")) < 1) & (F.col("font") != F.col("lf")) & (over > (F.col("x1") - F.col("x0")) / 2)).select(*page, "glyph_id").distinct()
    return glyphs.join(gone, [*page, "glyph_id"], "left_anti")


def direction(glyphs: DataFrame, page: list[str], least: int = 3) -> DataFrame:
    """(page, direction): how most glyphs of a page are turned; pages with fewer than ``least`` turned ones read upright."""
    turned = glyphs.groupBy(*page, "direction").agg(F.count("*").alias("n"))
    return turned.groupBy(*page).agg(F.max_by(F.when((F.col("direction") == "upright") | (F.col("n") >= least), F.col("direction")).otherwise("upright"), F.struct("n", "direction")).alias("direction"))


def text_lines(glyphs: DataFrame, page: list[str], y_tolerance: float = 3.0, x_gap: float = 2.0) -> DataFrame:
    """(page, line_no, top, line): glyphs grouped in lines by their top, in order of x, with a space where a gap opens."""
    down = Window.partitionBy(*page).orderBy("top", "x0", "glyph_id")
    g = glyphs.withColumn("__new", F.when(F.col("top") - F.lag("top").over(down) > y_tolerance, 1).otherwise(0)).withColumn("line_no", F.sum("__new").over(down) + 1)
    across = Window.partitionBy(*page, "line_no").orderBy("x0", "glyph_id")
    g = g.withColumn("__s", F.when(F.col("x0") - F.lag("x1").over(across) > x_gap, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    return g.groupBy(*page, "line_no").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.struct("x0", "glyph_id", "__s"))).alias("x")).select(*page, "line_no", "top", F.array_join(F.transform("x", lambda r: r["__s"]), "").alias("line"))


def two_columns(words: DataFrame, page: list[str], width: Column, least: int = 40) -> DataFrame:
    """(page, gutter): pages of ``least`` words or more where under 2 % cross the middle and a quarter or more lies on either side."""
    w = words.withColumn("__m", width / 2)
    counted = w.groupBy(*page).agg(F.count("*").alias("n"), F.count_if((F.col("x0") < F.col("__m")) & (F.col("x1") > F.col("__m"))).alias("c"), F.count_if(F.col("x1") <= F.col("__m")).alias("l"), F.count_if(F.col("x0") >= F.col("__m")).alias("r"), F.first("__m").alias("gutter"))
    return counted.filter((F.col("n") >= least) & (F.col("c") < 0.02 * F.col("n")) & (F.col("l") >= 0.25 * F.col("n")) & (F.col("r") >= 0.25 * F.col("n"))).select(*page, "gutter")


def inside(points: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, glyph_id, box_id): glyphs whose centre lies in a box.

    Pages of up to FEW boxes meet their glyphs by page. Only on pages with more do both sides meet on grid cells: a box has a row for every cell there, so that side is
    never broadcast, whatever its size is estimated at.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    p = points.select(*page, "glyph_id", x.alias("__x"), y.alias("__y"))
    b = boxes.select(*page, "box_id", "x0", "top", "x1", "bottom").withColumn("__n", F.count("*").over(Window.partitionBy(*page)))
    few, many = b.filter(F.col("__n") <= FEW), b.filter(F.col("__n") > FEW)
    dense = p.join(many.select(*page).distinct(), page, "left_semi").withColumn("__c", F.struct(F.floor(F.col("__x") / CELL).alias("cx"), F.floor(F.col("__y") / CELL).alias("cy")))
    placed = many.withColumn("__c", F.explode(cells(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"))))
    held = lambda pairs: pairs.filter((F.col("__x") >= F.col("x0")) & (F.col("__x") < F.col("x1")) & (F.col("__y") >= F.col("top")) & (F.col("__y") < F.col("bottom"))).select(*page, "glyph_id", "box_id").distinct()
    return held(p.join(few, page)).unionByName(held(dense.hint("merge").join(placed.hint("merge"), [*page, "__c"])))


def outside(points: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Glyphs in no box."""
    return points.join(inside(points, boxes, page).select(*page, "glyph_id").distinct(), [*page, "glyph_id"], "left_anti")


def nested_boxes(boxes: DataFrame, page: list[str], share: float = 0.9) -> DataFrame:
    """(page, box_id, outer_id): boxes with ``share`` of their area in a larger one."""
    a, b = boxes.alias("a"), boxes.alias("b")
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.bottom") - F.col(f"{t}.top"))
    wide = F.greatest(F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"), F.lit(0.0))
    tall = F.greatest(F.least("a.bottom", "b.bottom") - F.greatest("a.top", "b.top"), F.lit(0.0))
    on = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page] + [F.col("a.box_id") != F.col("b.box_id")]
    return a.join(b, on).filter((area("a") < area("b")) & (wide * tall >= share * area("a"))).select(*[F.col(f"a.{p}") for p in page], F.col("a.box_id").alias("box_id"), F.col("b.box_id").alias("outer_id"))


def tall_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes more than twice as tall as wide: tables that are turned."""
    return boxes.filter((F.col("bottom") - F.col("top")) > 2 * (F.col("x1") - F.col("x0")))


def image_pages(images: DataFrame, page: list[str], area: Column, share: float = 0.03) -> DataFrame:
    """Pages with an image of ``share`` of their area or more."""
    return images.filter((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top")) >= share * area).select(*page).distinct()


def reading_order(items: DataFrame, doc: list[str]) -> DataFrame:
    """Number items by page, column and height; items without a place follow the one before them."""
    given = Window.partitionBy(*doc).orderBy("item_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = items.withColumn("__k", F.last(F.when(F.col("page").isNotNull(), F.struct("page", "column", "top")), ignorenulls=True).over(given))
    return placed.withColumn("order", F.row_number().over(Window.partitionBy(*doc).orderBy("__k", "item_no"))).drop("__k")


def table_text(cells_: DataFrame, table: list[str]) -> DataFrame:
    """(table, row_no, line): the cells of a table's rows joined by `` | ``; rows without text go."""
    rows = cells_.groupBy(*table, "row_no").agg(F.array_sort(F.collect_list(F.struct("column_no", F.trim(F.coalesce("text", F.lit(""))).alias("t")))).alias("x"))
    return rows.filter(F.exists("x", lambda c: c["t"] != "")).select(*table, "row_no", F.array_join(F.transform("x", lambda c: c["t"]), " | ").alias("line"))


def transposed(cells_: DataFrame, turned: Column) -> DataFrame:
    """Rows and columns of turned tables changed over."""
    return cells_.withColumn("__r", F.col("row_no")).withColumn("row_no", F.when(turned, F.col("column_no")).otherwise(F.col("row_no"))).withColumn("column_no", F.when(turned, F.col("__r")).otherwise(F.col("column_no"))).drop("__r")


def line_gaps(rows: DataFrame, page: list[str]) -> DataFrame:
    """(page, tolerance): half the smallest gap between lines, 3 at most: how far glyphs of one line may lie apart."""
    gap = F.col("top") - F.lag("top").over(Window.partitionBy(*page).orderBy("top"))
    return rows.withColumn("__g", gap).filter("__g > 0").groupBy(*page).agg(F.least(F.lit(3.0), F.min("__g") / 2).alias("tolerance"))


def bands(rows: DataFrame, page: list[str], gutter: Column, gap: float = 3.0) -> DataFrame:
    """Number the bands of a two-column page: a line across the gutter, or a gap of ``gap`` line heights, opens one; (…, band, full)."""
    w = Window.partitionBy(*page).orderBy("top", "x0")
    full = (F.col("x0") < gutter) & (F.col("x1") > gutter)
    high = F.col("bottom") - F.col("top")
    new = (F.lag(full).over(w) != full) | (F.col("top") - F.lag("bottom").over(w) >= gap * high)
    return rows.withColumn("full", full).withColumn("band", F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).over(w))


def admitted(files: DataFrame, most_bytes: int = 100 << 20, most_pages: int = 500) -> tuple[DataFrame, DataFrame]:
    """Files within the limits, and the others with the reason; ``files`` has length and optionally n_pages."""
    reason = F.when(F.col("length") > most_bytes, "too large")
    if "n_pages" in files.columns:
        reason = reason.when(F.col("n_pages") > most_pages, "too many pages")
    marked = files.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def turned_majority(glyphs: DataFrame, area: list[str]) -> DataFrame:
    """(area, turned): whether most glyphs of an area are turned."""
    return glyphs.groupBy(*area).agg((F.avg((F.col("direction") != "upright").cast("double")) > 0.5).alias("turned"))


def strokes_across(strokes: DataFrame, page: list[str], gutter: Column, height: Column, least: int = 2) -> DataFrame:
    """Pages where two or more grid strokes cross the gutter, outside of a tenth of the height at either end."""
    inside_ = (F.col("x0") < gutter) & (F.col("x1") > gutter) & (F.col("top") > 0.1 * height) & (F.col("bottom") < 0.9 * height)
    return strokes.groupBy(*page).agg(F.count_if(inside_).alias("n")).filter(F.col("n") >= least).select(*page)


def tables_across(boxes: DataFrame, page: list[str], gutter: Column) -> DataFrame:
    """Pages with a table box over the gutter."""
    return boxes.filter((F.col("x0") < gutter) & (F.col("x1") > gutter)).select(*page).distinct()


def columns_of_boxes(boxes: DataFrame, page: list[str], width: Column, least: int = 8) -> DataFrame:
    """Pages whose boxes (eight or more) leave the middle free: under 5 % cross it, a quarter or more on either side."""
    b = boxes.withColumn("__m", width / 2)
    n = b.groupBy(*page).agg(F.count("*").alias("n"), F.count_if((F.col("x0") < F.col("__m")) & (F.col("x1") > F.col("__m"))).alias("c"), F.count_if(F.col("x1") <= F.col("__m")).alias("l"), F.count_if(F.col("x0") >= F.col("__m")).alias("r"))
    return n.filter((F.col("n") >= least) & (F.col("c") < 0.05 * F.col("n")) & (F.col("l") >= 0.25 * F.col("n")) & (F.col("r") >= 0.25 * F.col("n"))).select(*page)


def gap_runs_on(words: DataFrame, line: list[str], gutter: Column) -> DataFrame:
    """(line, runs_on): a line goes on over the gutter if the gap there is at most 1.2 times its largest other gap."""
    w = Window.partitionBy(*line).orderBy("x0")
    g = words.withColumn("__p", F.lag("x1").over(w)).filter("__p is not null").withColumn("__g", F.col("x0") - F.col("__p")).withColumn("__at", (F.col("__p") <= gutter) & (F.col("x0") >= gutter))
    return g.groupBy(*line).agg((F.max(F.when(F.col("__at"), F.col("__g"))) <= 1.2 * F.coalesce(F.max(F.when(~F.col("__at"), F.col("__g"))), F.lit(0.0))).alias("runs_on"))


def span_cells(cells_: DataFrame, table: list[str]) -> DataFrame:
    """One cell per span: the places that a merged cell covers, after its first, go."""
    return cells_.filter((F.col("row_no") == F.col("span_row")) & (F.col("column_no") == F.col("span_column")))


def page_text(parts: DataFrame, page: list[str], mark: str = "\x01") -> DataFrame:
    """(page, text): text parts of a page in order of band, column and height, a mark between columns of a band."""
    order = Window.partitionBy(*page).orderBy("band", "column", "top")
    new = (F.lag("band").over(order) == F.col("band")) & (F.lag("column").over(order) != F.col("column"))
    marked = parts.withColumn("__t", F.when(new, F.concat(F.lit(f"{mark}\n"), F.col("text"))).otherwise(F.col("text"))).withColumn("__n", F.row_number().over(order))
    return marked.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("__n", "__t"))).alias("x")).select(*page, F.array_join(F.transform("x", lambda r: r["__t"]), "\n").alias("text"))


def upside_down_last(glyphs: DataFrame) -> DataFrame:
    """Reading order keys: upright glyphs by top and x, then those turned half round from the bottom right."""
    half = F.col("direction") == "half"
    return glyphs.withColumn("order_key", F.struct(half, F.when(half, -F.col("bottom")).otherwise(F.col("top")), F.when(half, -F.col("x1")).otherwise(F.col("x0"))))


def clean_item(text: Column) -> Column:
    """An item's text without soft hyphens at line ends and blanks at its ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, "­\\s*\n\\s*", ""), "­", "")), F.lit(""))
