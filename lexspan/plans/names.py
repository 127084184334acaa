"""Queries of names, parties, scopes, outlines and warnings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import diff, lines, registry, sanity
from ..sources import files
from .common import table

NAMES = ["Águas do Norte, SA", "Sindicato Nacional dos Motoristas", "Associação dos Comerciantes (ACRAL)", "Federação Nacional dos Sindicatos - FNSTFPS", "SITESE - Sindicato dos Trabalhadores", "Câmara Municipal de Faro", "Empresa Municipal, EM", "de a", "BANCO de Portugal"]


def _pick(key: str, values: list):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(key: str, values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def party_sides(spark, sf_dir):
    """Signatories of orders, two names each: employers and unions, and the pair that a name uses."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(_pick("o_orderkey", NAMES), F.lit("; "), _pick("o_custkey", NAMES)).alias("s"))
    names = registry.parties("s")
    return o.select("o_orderkey", F.size(F.filter(names, registry.is_union)).alias("n_unions"), F.array_join(registry.chosen_parties(names), "|").alias("chosen"))


def scope_case(spark, sf_dir):
    names = _pick("o_orderkey", NAMES)
    kind = F.when(F.col("o_orderkey") % 5 == 0, "ACEP-ALT").otherwise("AE")
    o = table(spark, sf_dir, "orders").select(names.alias("name"), kind.alias("kind"))
    return o.select("name", "kind", registry.scope("name", "kind", r"\bcamara municipal\b|\bmunicipio\b", r"\bempresa municipal\b|\bem$").alias("scope")).groupBy("name", "kind", "scope").agg(F.count("*").alias("n"))


def order_references(spark, sf_dir):
    """Citations of government orders in texts built from orders: number, suffix and year, or nothing for impossible ones."""
    year = F.year("o_orderdate")
    text = F.concat(F.lit("Extensão pela Portaria n.º "), F.col("o_orderkey") % 500, F.when(F.col("o_custkey") % 3 == 0, "-A").otherwise(""), F.lit("/"), year + F.col("o_custkey") % 3 - 1, F.lit(", de 5 de maio"))
    ref = registry.order_reference("t", F.col("y"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"), year.alias("y")).select("o_orderkey", ref["number"].alias("number"), ref["suffix"].alias("suffix"), ref["year"].alias("year"))


def doc_id_parsing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    issue = F.col("o_orderkey") % 50 + 1
    doc = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2026_BTE_"), F.lpad(issue.cast("string"), 2, "0"), F.lit("_PRI_"), F.col("o_custkey"), F.lit("_CCT-ALT_27251_ACRAL-CESP+2")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("25_PR_"), F.col("o_custkey"), F.lit("_BTE_"), issue, F.lit("_EMARP_SINTAP"))).otherwise(F.concat(F.lit("other_"), F.col("o_custkey")))
    )
    p = files.doc_id_parts("doc")
    return o.select("o_orderkey", doc.alias("doc")).select("o_orderkey", p["scheme"].alias("scheme"), p["year"].alias("year"), p["issue"].alias("issue"), p["seq"].alias("seq"), F.array_join(p["acronyms"], "|").alias("acronyms"), p["others"].alias("others"))


def subtype_case(spark, sf_dir):
    a = _pick("o_orderkey", ["1.ª convenção", "Revisão GLOBAL", "Revisão parcial", "", "outra"])
    b = _pick("o_custkey", ["", "Alteração e texto consolidado", "Alteração"])
    return table(spark, sf_dir, "orders").groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n")).select("a", "b", files.subtype("a", "b").alias("subtype"), "n")


def acronym_guess(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(_pick("o_orderkey", NAMES).alias("name")).agg(F.count("*").alias("n")).select("name", registry.guessed_acronym("name").alias("guessed"), registry.is_union("name").alias("is_union"), fx.entity_key("name").alias("key"), "n")


def file_years(spark, sf_dir):
    names = _pick("o_orderkey", ["3_BTE_2_ACIP", "26_PR_003_BTE_31_X", "2024_BTE_31_PRI_377_CCT_1_X", "25146_X", "2019 texto", "antigo"])
    return table(spark, sf_dir, "orders").groupBy(names.alias("name")).agg(F.count("*").alias("n")).select("name", diff.file_year(F.col("name")).alias("year"), "n")


def long_lines(spark, sf_dir):
    return sanity.long_lines(lines.lines(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"], 600).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def secret_scan(spark, sf_dir):
    return sanity.secrets(table(spark, sf_dir, "documents"))


def unclosed_clauses(spark, sf_dir):
    """Documents as clauses: those that are empty or hold no closed sentence."""
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select("doc_id", F.lit("n0").alias("node_id"), F.lit("clause").alias("type"), F.lit("c").alias("label"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("leaf"), "text").withColumnRenamed("text", "span")
    return sanity.clauses_without_body(nodes).select("doc_id", "problem")


def confirmed_acronyms(spark, sf_dir):
    """Two people's answers for each segment's acronym: contradictions and empty ones are refused."""
    c = table(spark, sf_dir, "customer")
    answer = F.when(F.col("c_nationkey") == 3, "!!").when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("B"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("X-"), F.left("c_mktsegment", F.lit(4))))
    return registry.decisions(c.select(F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey") % 4).alias("entity"), answer.alias("answer"))).select("entity", "error", F.when(F.col("error").isNull(), F.col("acronym")).alias("acronym"))


def type_keys(spark, sf_dir):
    kinds = _pick("o_orderkey", ["cct - alt", "  Ae-Rect ", "ACÓRDÃO  x", "PE"])
    return table(spark, sf_dir, "orders").groupBy(kinds.alias("kind")).agg(F.count("*").alias("n")).select("kind", fx.type_key("kind").alias("key"), "n")


def paragraph_words(spark, sf_dir):
    """Words that look read backwards, per document; every third document is read backwards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"))
    rows = docs.select("doc_id", F.explode(fx.words("text")).alias("word"))
    return rows.filter(fx.looks_reversed(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    party_sides, scope_case, order_references, doc_id_parsing, subtype_case, acronym_guess, file_years, long_lines, secret_scan, unclosed_clauses, confirmed_acronyms, type_keys,
    paragraph_words,
)}

_UNION = "contains(lower({0}), 'sindic')"
_A, _B = _sql_pick("o_orderkey", NAMES), _sql_pick("o_custkey", NAMES)
_SUBA, _SUBB = _sql_pick("o_orderkey", ["1.ª convenção", "Revisão GLOBAL", "Revisão parcial", "", "outra"]), _sql_pick("o_custkey", ["", "Alteração e texto consolidado", "Alteração"])
_KEYS = ["aguas do norte, sa", "sindicato nacional dos motoristas", "associacao dos comerciantes (acral)", "federacao nacional dos sindicatos - fnstfps", "sitese - sindicato dos trabalhadores", "camara municipal de faro", "empresa municipal, em", "de a", "banco de portugal"]

ORACLE_SQL = {
    "party_sides": f"""WITH p AS (SELECT o_orderkey, {_A} AS a, {_B} AS b FROM orders), u AS (SELECT *, {_UNION.format('a')} AS ua, {_UNION.format('b')} AS ub FROM p)
SELECT o_orderkey, CAST(ua::INT + ub::INT AS INTEGER) AS n_unions, CASE WHEN ua AND NOT ub THEN b || '|' || a ELSE a || '|' || b END AS chosen FROM u""",
    "scope_case": f"""WITH p AS (SELECT {_A} AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'ACEP-ALT' ELSE 'AE' END AS kind FROM orders)
SELECT name, kind, CASE WHEN kind = 'ACEP-ALT' OR name = 'Câmara Municipal de Faro' THEN 'APU' WHEN name = 'Empresa Municipal, EM' THEN 'SPE' ELSE 'PRI' END AS scope, count(*) AS n FROM p GROUP BY ALL""",
    "order_references": """WITH p AS (SELECT o_orderkey, o_orderkey % 500 AS n, o_custkey % 3 AS k FROM orders), y AS (SELECT p.*, year(o_orderdate) AS y FROM p JOIN orders USING (o_orderkey))
SELECT o_orderkey, CAST(CASE WHEN n > 0 AND k < 2 THEN n END AS INTEGER) AS number, CASE WHEN n > 0 AND k < 2 THEN CASE WHEN k = 0 THEN 'A' ELSE '' END END AS suffix, CAST(CASE WHEN n > 0 AND k < 2 THEN y + k - 1 END AS INTEGER) AS year FROM y""",
    "doc_id_parsing": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'scope' WHEN 1 THEN 'short' END AS scheme, CAST(CASE o_orderkey % 3 WHEN 0 THEN 2026 WHEN 1 THEN 2025 END AS INTEGER) AS year, CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 50 + 1 END AS INTEGER) AS issue,
CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_custkey END AS INTEGER) AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'ACRAL|CESP' WHEN 1 THEN 'EMARP|SINTAP' END AS acronyms, CAST(CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS INTEGER) AS others FROM orders""",
    "subtype_case": f"""WITH p AS (SELECT {_SUBA} AS a, {_SUBB} AS b FROM orders)
SELECT a, b, CASE WHEN a = '1.ª convenção' THEN 'primeira_convencao' WHEN a = 'Revisão GLOBAL' THEN 'revisao_global' WHEN a = 'Revisão parcial' AND b LIKE '%texto%' THEN 'revisao_parcial_com_consolidado' WHEN a = 'Revisão parcial' THEN 'revisao_parcial' WHEN b LIKE '%texto%' THEN 'texto_consolidado' ELSE 'desconhecido' END AS subtype, count(*) AS n FROM p GROUP BY ALL""",
    "acronym_guess": f"SELECT {_A} AS name, {_sql_pick('o_orderkey', [None, None, 'ACRAL', 'FNSTFPS', 'SITESE', None, None, None, None])} AS guessed, {_UNION.format(_A)} AS is_union, {_sql_pick('o_orderkey', _KEYS)} AS key, count(*) AS n FROM orders GROUP BY ALL",
    "file_years": "SELECT ['3_BTE_2_ACIP', '26_PR_003_BTE_31_X', '2024_BTE_31_PRI_377_CCT_1_X', '25146_X', '2019 texto', 'antigo'][o_orderkey % 6 + 1] AS name, CAST([2025, 2026, 2024, 2025, 2019, NULL][o_orderkey % 6 + 1] AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL",
    "secret_scan": r"""WITH r(rule, p) AS (VALUES ('private key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('aws key', '\bAKIA[0-9A-Z]{16}\b'), ('github token', '\bgh[pousr]_[A-Za-z0-9]{36,}\b'), ('assigned secret', '(?i)\b(?:api[_-]?key|secret|token|password)\s*[=:]\s*[''"]?[A-Za-z0-9_\-]{16,}'))
SELECT doc_id, rule, CAST(len(regexp_extract_all(text, p)) AS INTEGER) AS n FROM documents, r WHERE len(regexp_extract_all(text, p)) > 0""",
    "long_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
n AS (SELECT *, lag(line) OVER w AS p, lead(line) OVER w AS q, string_split(line, ' | ') AS cells, string_split_regex(trim(line, E' \t\n\r\f\x0B'), '\s+') AS t FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT *, length(line) AS len, contains(line, ' | ') AS celled, len(list_filter(t, lambda x: regexp_matches(x, '\d'))) > 0.4 * len(t) AS numeric,
  coalesce(contains(p, ' | ') AND len(string_split(p, ' | ')) = len(cells), false) OR coalesce(contains(q, ' | ') AND len(string_split(q, ' | ')) = len(cells), false) AS twin,
  length(array_to_string(list_filter(cells, lambda c: len(string_split_regex(trim(c), '\s+')) < 10 OR len(list_filter(string_split_regex(trim(c), '\s+'), lambda x: regexp_matches(x, '\d'))) > 0.4 * len(string_split_regex(trim(c), '\s+'))), ' | ')) AS short FROM n WHERE length(line) > 600)
SELECT doc_id, count(*) AS n, CAST(max(len) AS INTEGER) AS longest FROM f WHERE (celled OR numeric) AND NOT (celled AND (twin OR short <= 600)) GROUP BY doc_id""",
    "unclosed_clauses": r"""WITH b AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '^[^\n]*\n?', ''), '^[\s\x0B\x85\x{A0}\p{Z}]+', ''), '[\s\x0B\x85\x{A0}\p{Z}]+$', '') AS body FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '' AND regexp_matches(x, '(?:[.!?]|\d\.?\s?[ªº])[\s)\]»”"'']*$'))) > 0 AS closed FROM b)
SELECT doc_id, CASE WHEN body = '' THEN 'empty' ELSE 'no closed sentence' END AS problem FROM c WHERE body = '' OR (NOT closed AND NOT regexp_matches(text, ' \| |\(\s*(?:\.\s*){3}\)|\(\s*…\s*\)|\[\s*(?:\.\s*){3}\]|[=×]'))""",
    "confirmed_acronyms": """WITH a AS (SELECT c_mktsegment || '/' || (c_nationkey % 4) AS entity, CASE WHEN c_nationkey = 3 THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'B' || c_nationkey ELSE 'X' || left(c_mktsegment, 4) END AS x FROM customer), g AS (SELECT entity, min(x) AS m, count(DISTINCT x) AS n FROM a GROUP BY entity)
SELECT entity, CASE WHEN m = '' THEN 'empty' WHEN n > 1 THEN 'contradiction' END AS error, CASE WHEN m <> '' AND n = 1 THEN m END AS acronym FROM g""",
    "type_keys": "SELECT ['cct - alt', '  Ae-Rect ', 'ACÓRDÃO  x', 'PE'][o_orderkey % 4 + 1] AS kind, ['CCT-ALT', 'AE-RECT', 'ACORDAO X', 'PE'][o_orderkey % 4 + 1] AS key, count(*) AS n FROM orders GROUP BY ALL",
    "paragraph_words": r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN reverse(text) ELSE text END, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS word FROM documents) x WHERE regexp_matches(word, '^[a-zà-ÿ]{3,}[A-ZÀ-Ý]$') GROUP BY doc_id",
}
