"""Checks around a run, and the smaller geometry operators."""

from pyspark.sql import functions as F

from lexspan.operators import geometry, upkeep


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_addresses(spark):
    urls = ["https://a.example/x", "http://a.example/x", "https://b.example/", "http://127.0.0.1:1234/v1", "http://u:p@localhost/", None]
    got = [(r["a"], r["b"]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(upkeep.allowed_url("u", ["a.example"]).alias("a"), upkeep.local_url("u").alias("b")).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False), (False, False)]


def test_files(spark):
    files = spark.createDataFrame([("data/raw/x", 5), ("docs/data/raw/y", 7), ("z", 1)], "path string, length long")
    assert rows(upkeep.inventory(files, upkeep.path_class("path", [("data/raw", "raw")])), "class", "n_files", "n_bytes") == [("other", 1, 1), ("raw", 2, 12)]
    pages = spark.createDataFrame([("docs/a.md", "[x](b.md) [y](../c.md#h) [z](https://e) [w](no.md) [v](./d/../b.md)")], "path string, text string")
    assert rows(upkeep.broken_links(pages, spark.createDataFrame([("docs/b.md",), ("c.md",)], "path string")), "target") == [("no.md",)]


def test_grouping_bench_and_contracts(spark):
    warned = spark.createDataFrame([("w", "b"), ("w", "a"), ("v", "c")], "t string, d string")
    assert rows(upkeep.grouped_warning(warned, "t", "d"), "warning", "n", "items") == [("v", 1, "c"), ("w", 2, "a, b")]
    answers = spark.createDataFrame([("m", "A", "A", 1.0), ("m", "A", None, 2.0), ("m", None, "B", 3.0), ("m", None, None, 2.0), ("m", "A", "!", 2.0)], "model string, expected string, got string, seconds double")
    assert rows(upkeep.model_bench(answers), "hits", "false_positives", "false_negatives", "invalid", "mean_latency") == [(2, 1, 1, 1, 2.0)]
    data = spark.createDataFrame([(1, "a", "new", 0), (2, " ", "x", -1), (3, None, None, 5)], "id int, key string, state string, start int")
    assert rows(upkeep.contract_violations(data, ["key"], {"state": ["new"]}, {"start": 0}), "id", "problems") == [(2, ["key missing", "state unknown", "start too small"]), (3, ["key missing"])]


def test_small_geometry(spark):
    words = spark.createDataFrame([(1, 0.0, 10.0), (1, 12.0, 20.0), (1, 60.0, 70.0), (2, 0.0, 10.0), (2, 15.0, 48.0), (2, 52.0, 70.0)], "line int, x0 double, x1 double")
    assert rows(geometry.gap_runs_on(words, ["line"], F.lit(50.0)), "line", "runs_on") == [(1, False), (2, True)]
    parts = spark.createDataFrame([(1, 0, 1, 5.0, "right"), (1, 0, 0, 9.0, "left"), (1, 1, 0, 20.0, "below")], "page int, band int, column int, top double, text string")
    assert rows(geometry.page_text(parts, ["page"]), "text") == [("left\n\x01\nright\nbelow",)]
    boxes = spark.createDataFrame([(1, 40.0, 60.0), (2, 0.0, 30.0)], "page int, x0 double, x1 double")
    assert rows(geometry.tables_across(boxes, ["page"], F.lit(50.0)), "page") == [(1,)]
    assert spark.range(1).select(geometry.clean_item(F.lit(" a­\n b ")).alias("t")).first()["t"] == "ab"
