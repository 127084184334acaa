"""Queries of outlines: agreements written from orders and their line items, and what their outline must be."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import structure
from .common import table


def agreements(spark, sf_dir):
    """(doc_id, text): a title, a chapter, a clause with two items for each line item, an annex with a line, and a signature."""
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    clause = F.array_join(F.array(
        F.concat(F.lit("Cláusula "), "n", F.lit(".ª")), F.concat(F.lit("Objeto "), "l_partkey"), F.concat(F.lit("1- Aplica-se a "), F.col("l_quantity").cast("int"), F.lit(" casos.")), F.concat(F.lit("2- Vale em "), "l_suppkey", F.lit(".")),
    ), "\n")
    clauses = items.withColumn("n", n).groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", clause.alias("c")))), lambda x: F.concat(x["c"], F.lit("\n"))), "").alias("clauses"))
    text = F.concat(F.lit("Acordo "), "o_orderkey", F.lit("\nCAPÍTULO I\nDisposições\n"), F.coalesce("clauses", F.lit("")), F.lit("ANEXO I\nValores "), "o_custkey", F.lit("\nO valor é de "), "o_custkey", F.lit(".\nPela Empresa "), "o_orderkey", F.lit(":"))
    # either side grows with the orders: both are dealt by them, so the outlines that follow are as many tasks
    return o.join(clauses.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def document_outline(spark, sf_dir):
    """Every node of the agreements' outlines with its parent's label and its length."""
    rows = structure.node_rows(agreements(spark, sf_dir))
    return rows.select("doc_id", "type", "label", "parent", (F.col("char_end") - F.col("char_start")).alias("n_chars"), "leaf")


def outline_zero_loss(spark, sf_dir):
    """Agreements put together again from the spans of their leaves."""
    spans = structure.leaf_spans(agreements(spark, sf_dir)).filter(F.size("spans") > 0)
    return spans.select("doc_id", F.size("spans").cast("bigint").alias("n_leaves"), F.md5(F.array_join("spans", "")).alias("md5"))


QUERIES = {f.__name__: f for f in (document_outline, outline_zero_loss)}

_ITEMS = "i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q, l_suppkey AS s FROM lineitem), c AS (SELECT doc_id, n, 'Cláusula ' || n || '.ª - Objeto ' || p AS label, '1- Aplica-se a ' || q || ' casos.' AS one, '2- Vale em ' || s || '.' AS two FROM i JOIN orders ON o_orderkey = doc_id)"

ORACLE_SQL = {
    "document_outline": f"""WITH {_ITEMS}
SELECT o_orderkey AS doc_id, 'preamble' AS type, 'PREAMBLE' AS label, '' AS parent, CAST(length('Acordo ' || o_orderkey) + 1 AS INTEGER) AS n_chars, true AS leaf FROM orders
UNION ALL SELECT o_orderkey, 'chapter', 'CAPÍTULO I - Disposições', '', 25, true FROM orders
UNION ALL SELECT doc_id, 'clause', label, 'CAPÍTULO I - Disposições', CAST(length(label) + length(one) + length(two) + 3 AS INTEGER), true FROM c
UNION ALL SELECT doc_id, 'paragraph', one, label, CAST(length(one) + 1 AS INTEGER), false FROM c
UNION ALL SELECT doc_id, 'paragraph', two, label, CAST(length(two) + 1 AS INTEGER), false FROM c
UNION ALL SELECT o_orderkey, 'annex', 'ANEXO I - Valores ' || o_custkey, '', CAST(length('ANEXO I - Valores ' || o_custkey) + 1 AS INTEGER), true FROM orders
UNION ALL SELECT o_orderkey, 'block', 'Body of ANEXO I - Valores ' || o_custkey, 'ANEXO I - Valores ' || o_custkey, CAST(length('O valor é de ' || o_custkey || '.') + 1 AS INTEGER), true FROM orders
UNION ALL SELECT o_orderkey, 'block', 'SIGNATURES', '', CAST(length('Pela Empresa ' || o_orderkey || ':') + 1 AS INTEGER), true FROM orders""",
    "outline_zero_loss": f"""WITH {_ITEMS}, t AS (SELECT doc_id, count(*) AS n, string_agg(label || chr(10) || one || chr(10) || two || chr(10), '' ORDER BY n) AS body FROM c GROUP BY doc_id)
SELECT o_orderkey AS doc_id, 5 + coalesce(n, 0) AS n_leaves, md5('Acordo ' || o_orderkey || chr(10) || 'CAPÍTULO I - Disposições' || chr(10) || coalesce(body, '') || 'ANEXO I - Valores ' || o_custkey || chr(10) || 'O valor é de ' || o_custkey || '.' || chr(10) || 'Pela Empresa ' || o_orderkey || ':' || chr(10)) AS md5
FROM orders LEFT JOIN t ON doc_id = o_orderkey""",
}
