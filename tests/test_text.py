"""Text functions against known values."""

import difflib

import pytest
from pyspark.sql import functions as F

from lexspan.functions import text as fx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "label,key",
    [
        ("Cláusula 12.ª - Horário", "cl12"), ("CLÁUSULA DÉCIMA SEGUNDA - Horário", "cl12"), ("Cláusula 16.ª-A - Férias", "cl16A"), ("Artigo único - Âmbito", "arunico"),
        ("Cláusula prévia - Âmbito da revisão", "clprevia"), ("Cláusula de revisão", "clrevisao"), ("Cláusula VII-8 - Ajudas de custo", "clVII-8"), ("Cláusula geral e transitória", None),
        ("Cláusula civil", None), ("Capítulo I", None), (None, None), ("Artigo 007.º", "ar7"), ("Cláusula centésima vigésima primeira", "cl121"), ("Cláusula primeira décima", "cl1"), ("ARTIGO 3", "ar3"),
    ],
)
def test_number_key(spark, label, key):
    assert one(spark, label, fx.number_key("x")) == key


@pytest.mark.parametrize("words,value", [("décima segunda", 12), ("vigésima primeira", 21), ("primeira vigésima", None), ("nonagésima nona", 99), ("setuagésimo", 70), ("décima qualquer", None), ("", None)])
def test_spelled_ordinal(spark, words, value):
    assert one(spark, words, fx.spelled_ordinal("x")) == value


def test_normalisers(spark):
    assert one(spark, "  Ação \n DA  É́poca ", fx.fold_text("x")) == "acao da epoca"
    assert one(spark, " Á  b\n", fx.plain_lower("x")) == "á b"
    assert one(spark, "N.º do Boletim:", fx.header_key("x")) in ("nodoboletim", "nºdoboletim")
    assert one(spark, "Águas-do Norte 2", fx.collapsed("x")) == "aguasdonorte2"
    assert one(spark, " .Banco; Sul., ", fx.entity_key("x")) == "banco; sul"
    assert one(spark, "S.N.M. - Á", fx.acronym("x")) == "SNMA"
    assert one(spark, "AguasRibatejo SA 12", fx.camel_parts("x")) == ["Aguas", "Ribatejo", "SA", "12"]
    assert [one(spark, v, fx.messy_int("x")) for v in ("31.0", " 31 ", "x", "", None, "-4", "3.5x")] == [31, 31, None, None, None, -4, None]
    assert one(spark, "1.402.3", fx.lineage("x")) == "1.402" and one(spark, "1.10.x", fx.numeric_order("x")) == [1, 10, 0]
    assert [one(spark, v, fx.yearly_number("x")) for v in ("377/2026", "15", "a/2026")] == [377, 15, None]


def test_words_keep_unicode(spark):
    assert one(spark, "As férias, nº 3_a — ção", fx.words("x")) == ["As", "férias", "nº", "3_a", "ção"]


def test_context_and_classes(spark):
    assert one(spark, "x" * 100 + "needle" + "y" * 100, fx.in_context("x", F.lit("needle"), 5)) == "…xxxxxneedleyyyyy…"
    assert one(spark, "a\nneedle", fx.in_context("x", F.lit("needle"))) == "a ⏎ needle" and one(spark, "z", fx.in_context("x", F.lit("needle"))) == ""
    got = spark.createDataFrame([("Aa1, b.",)], "x string").select(*[c.alias(k) for k, c in fx.char_classes("x").items()]).first().asDict()
    assert got == {"letters": 3, "digits": 1, "commas": 1, "stops": 1, "a": 2}


@pytest.mark.parametrize("code,path", [("REVIEW/4.08.4.1", ["REVIEW", "4.08", "4.08.4", "4.08.4.1"]), ("Structure/Preamble", ["Structure", "Preamble"]), ("A/A/4.1", ["A", "4.1"])])
def test_code_path(spark, code, path):
    assert one(spark, code, fx.code_path("x")) == path


def test_json_array(spark):
    assert one(spark, 'text [{"a": [1]}] end', fx.json_array("x")) == '[{"a": [1]}]' and one(spark, "none", fx.json_array("x")) == ""


def test_reversed_shape(spark):
    assert [one(spark, v, fx.looks_reversed(F.col("x"))) for v in ("sagloF", "Folgas", "abC", "levíN")] == [True, False, False, True]


def test_difflib_is_the_measure():
    from lexspan.operators import diff

    assert diff.similarity("Ação A", "acao  a") == 1.0
    assert diff.similarity("abc", "abd") == difflib.SequenceMatcher(None, "abc", "abd").ratio()
