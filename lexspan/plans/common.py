"""Shared by the query plans: table reading and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ACCENTED, PLAIN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of documents with offsets, as DuckDB tells them.
SQL_LINES = """lines AS (
  SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start, n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, length(text) AS n FROM documents) x
), placed AS (SELECT doc_id, line_no, line, char_start, CAST(least(char_start + length(line) + 1, n) AS INTEGER) AS char_end FROM lines)"""


def sql_strip(c: str) -> str:
    return f"regexp_replace(translate({c}, '{ACCENTED}', '{PLAIN}'), '[̀-ͯ]', '', 'g')"


def sql_squeeze(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


#: Words: letters, marks, digits, connectors.
SQL_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"
