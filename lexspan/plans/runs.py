"""Queries of names, admission, the catalogue's projection, stored files and runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import admission, catalogue, evaluation, registry
from .common import table


def _pick(key, values: list):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(key: str, values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def _names(spark, sf_dir):
    """Orders as file names in three schemes, in none, and as whole issues."""
    seq = F.format_string("%03d", F.col("o_orderkey") % 1000)
    name = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("2026_BTE_31_PRI_"), seq, F.lit("_CCT-ALT_27251_A-B"))).when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("2026_BTE_31_PE_"), seq, F.lit("_0452A-2025_27251_A-B")))
        .when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit("2026_BTE_31_AA_"), seq, F.lit("_27251_A"))).when(F.col("o_orderkey") % 7 == 3, F.concat(F.lit("26_"), _pick(F.col("o_custkey"), ["PR", "PE", "AV", "AA", "ZZ"]), F.lit("_"), seq, F.lit("_BTE_31_A_B")))
        .when(F.col("o_orderkey") % 7 == 4, F.concat(F.lit("2026_001_BTE_01_"), _pick(F.col("o_custkey"), ["PE", "PCT", "AA", "XX"]), F.lit("_"), seq)).when(F.col("o_orderkey") % 7 == 5, F.concat(F.lit("bte"), F.col("o_custkey"), F.lit("_2021"))).otherwise(F.concat(F.lit("texto "), seq))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


def name_families(spark, sf_dir):
    return _names(spark, sf_dir).select("o_orderkey", admission.name_family("name").alias("family"), admission.suspected_family("name").alias("suspect"))


def refused_files(spark, sf_dir):
    files = _names(spark, sf_dir).select(F.concat("name", F.lit(".pdf")).alias("name"))
    return admission.refused(files).groupBy("reason").agg(F.count("*").alias("n"))


def resolved_subtypes(spark, sf_dir):
    subtype, kind = admission.resolved_subtype("name", F.when(F.col("o_orderkey") % 5 == 0, "revisao_parcial").otherwise(""), F.when(F.col("o_orderkey") % 4 == 0, "AE-RECT").when(F.col("o_orderkey") % 4 == 1, "AE"))
    return _names(spark, sf_dir).select("o_orderkey", subtype.alias("subtype"), kind.alias("type"))


def entries_to_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    entries = o.select(F.col("o_orderkey").alias("key"), _pick(F.col("o_orderkey"), ["agreement", "extension", "notice", "accession"]).alias("family"), _pick(F.col("o_custkey"), ["descarregado", "falhado", "inalterado", "ignorado"]).alias("state"))
    confirmed = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    return admission.named_entries(entries, ["agreement", "notice", "accession"], confirmed).select("key")


def long_names(spark, sf_dir):
    """Names in the long scheme; null where a part is missing or the name can't fit."""
    kind, doc_type = _pick(F.col("o_orderkey"), ["agreement", "extension", "accession", "notice"]), _pick(F.col("o_orderkey"), ["CCT-ALT", "PE", "AA", "AVISO"])
    order = F.struct((F.col("o_orderkey") % 500).cast("int").alias("number"), F.when(F.col("o_orderkey") % 3 == 0, "B").otherwise("").alias("suffix"), F.lit(2025).alias("year"))
    code = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("2"), F.format_string("%04d", F.col("o_orderkey") % 10000)))
    head = registry.long_prefix(F.year("o_orderdate"), (F.col("o_orderkey") % 52).cast("int"), kind, F.lit("PRI"), doc_type, (F.col("o_orderkey") % 1000).cast("int"), order, code)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    return o.select("o_orderkey", registry.compose_name(head, F.array(fx.acronym("c_name"), fx.acronym("c_mktsegment")), F.col("o_custkey") % 3).alias("name"))


def short_names(spark, sf_dir):
    kind = _pick(F.col("o_orderkey"), ["agreement", "extension", "accession", "notice"])
    head = registry.short_prefix(F.year("o_orderdate"), kind, (F.col("o_orderkey") % 1000).cast("int"), (F.col("o_orderkey") % 52).cast("int"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    return o.select("o_orderkey", registry.short_name(head, F.array(fx.acronym("c_name"), F.concat(fx.acronym("c_mktsegment"), F.lit("ABCDEFGHIJKLMNOPQRST"), fx.acronym("c_name")))).alias("name"))


def base_acronyms(spark, sf_dir):
    given = _pick(F.col("s_suppkey"), ["A.C.E.", "ugt", "X", "", "SNM 2"])
    name, source = registry.base_acronym(F.concat(F.lit("Sindicato "), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("(ABC"), "s_suppkey", F.lit(")"))).otherwise(F.lit("dos Motoristas"))), given)
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("acronym"), source.alias("source"))


def _items(spark, sf_dir):
    """Orders as items of a bulletin's index."""
    c = F.col("o_custkey")
    employer = F.when(c % 5 == 0, F.concat(F.lit("Câmara Municipal "), c)).when(c % 5 == 1, F.concat(F.lit("Empresa "), c, F.lit(", EM"))).otherwise(F.concat(F.lit("Empresa "), c, F.lit(", SA")))
    union = F.concat(F.lit("Sindicato "), "o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("doc_"), F.col("o_orderkey"))).alias("name"), F.when(c % 7 == 0, "check").alias("warnings"), _pick(F.col("o_orderkey"), ["CCT - ALT", "ae", "PE", "AVISO", "AA", "ST"]).alias("type"),
        F.concat(F.lit("Acordo "), F.col("o_orderkey")).alias("title"), F.when(F.col("o_orderkey") % 4 == 0, union).otherwise(F.concat(employer, F.lit("; "), union)).alias("signatories"), F.when(F.col("o_orderkey") % 3 == 0, "Transportes; CAE 12; Transportes").otherwise("Comércio").alias("sectors"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CCT.20250708."), F.col("o_orderkey") % 400, F.lit("/2025; outra"))).alias("chain"), F.concat(F.lpad((F.col("o_orderkey") % 50).cast("string"), 4, "0"), F.lpad((F.col("o_orderkey") % 70).cast("string"), 4, "0"), F.lit(".pdf")).alias("file"), F.concat(F.lit("https://x/"), F.col("o_orderkey")).alias("url"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("9"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))).otherwise("C-12").alias("code"), F.when(c % 2 == 0, "11111; 22222 33333").alias("base_codes"),
        F.lit("452/2025").alias("order_ref"), F.lit(None).cast("string").alias("in_force"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 52).cast("int").alias("issue_no"), (F.col("o_orderkey") % 1000).cast("int").alias("yearly_no"),
    )


def catalogue_projection(spark, sf_dir):
    return catalogue.project(_items(spark, sf_dir), ["cae"], r"\bcamara\b", r"\bem$")


def catalogue_counts(spark, sf_dir):
    rows = catalogue_projection(spark, sf_dir).withColumn("name", F.when(F.col("yearly_no") == 7, F.concat(F.lit("same "), "issue_no")).otherwise(F.col("name")))
    return catalogue.counts(rows)


def stored_files(spark, sf_dir):
    """Pages as a manifest and, two thirds of them, as stored files; every fifth has no size, every seventh no URL."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), "url")
    manifest = p.select("page_id", "sha256", F.when(F.col("page_id") % 5 > 0, F.col("bytes")).alias("bytes"), F.when(F.col("page_id") % 7 > 0, F.col("url")).alias("url"))
    held = p.filter("page_id % 3 > 0").select(F.format_string("f%08d", "page_id").alias("path"), "bytes", "sha256")
    return admission.stored_files(manifest, held).select("page_id", "path", "state")


def urls_by_content(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), "url")
    manifest = p.select("page_id", "sha256", F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("url"))
    found = p.filter("page_id % 2 = 0").select("sha256", "url", F.col("page_id").alias("line_no"))
    return admission.urls_by_content(manifest, found).select("page_id", "url", "added")


def corpus_states(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    measured = p.filter("page_id % 4 > 0").select(F.col("page_id").alias("name"), F.when(F.col("page_id") % 9 == 0, "ValueError: no text").alias("error"), F.when(F.col("page_id") % 9 > 0, F.length("html")).alias("n_chars"))
    return admission.corpus_states(p.select(F.col("page_id").alias("name")), measured, ["n_chars"])


def _runs(spark, sf_dir):
    from .coding import gold, predictions

    first = predictions(spark, sf_dir).filter("doc_id % 3 > 0")
    more = predictions(spark, sf_dir).filter("doc_id % 3 = 0")
    return first, admission.all_annotations(first, more), gold(spark, sf_dir)


def further_gain(spark, sf_dir):
    """What the annotations of a second run, on every third document, add to those of the first."""
    return admission.gain(*_runs(spark, sf_dir))


def already_complete(spark, sf_dir):
    first, _, reference = _runs(spark, sf_dir)
    return admission.already_complete(first, reference)


def rejoined_pages(spark, sf_dir):
    """Documents cut into pages of 40 characters with a hyphen at every cut: their words written whole again."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40).cast("int")), lambda i: F.concat(F.substr(F.col("text"), i * 40 + 1, F.lit(40)), F.lit("-")))
    docs = table(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", F.regexp_replace("text", r"[^a-z]", "").alias("text")).filter("length(text) > 0")
    pages = docs.select("doc_id", F.posexplode(cut).alias("page", "text"))
    return evaluation.rejoined_pages(pages, ["doc_id"], "page").select("doc_id", "page", "text")


def longest_fragments(spark, sf_dir):
    """The twelve longest lines, in words, of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("n_words", F.size(fx.words("line")))
    return evaluation.longest_fragments(rows, ["doc_id"], "n_words", "place").select("doc_id", "rank", "place", "n_words")


def label_types(spark, sf_dir):
    label = F.concat(_pick(F.col("o_orderkey"), ["", "Anexo\\", "Texto\\"]), _pick(F.col("o_custkey"), ["PREÂMBULO", "Cláusula 1.ª", "Artigo 2.º - X", "Capítulo I", "Secção II", "Anexo A", "Nota", " Clausula 3"]), F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return rows.select("label", admission.label_type("label").alias("type"), "n")


QUERIES = {f.__name__: f for f in (
    name_families, refused_files, resolved_subtypes, entries_to_name, long_names, short_names, base_acronyms, catalogue_projection, catalogue_counts, stored_files, urls_by_content, corpus_states, further_gain, already_complete,
    rejoined_pages, longest_fragments, label_types,
)}

_NAMES = f"""n AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '2026_BTE_31_PRI_' || s || '_CCT-ALT_27251_A-B' WHEN 1 THEN '2026_BTE_31_PE_' || s || '_0452A-2025_27251_A-B' WHEN 2 THEN '2026_BTE_31_AA_' || s || '_27251_A'
WHEN 3 THEN '26_' || {_sql_pick('o_custkey', ['PR', 'PE', 'AV', 'AA', 'ZZ'])} || '_' || s || '_BTE_31_A_B' WHEN 4 THEN '2026_001_BTE_01_' || {_sql_pick('o_custkey', ['PE', 'PCT', 'AA', 'XX'])} || '_' || s WHEN 5 THEN 'bte' || o_custkey || '_2021' ELSE 'texto ' || s END AS name
FROM (SELECT *, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS s FROM orders) x),
f AS (SELECT *, regexp_extract(name, '^20\\d\\d_BTE_\\d+_([A-Z]+)_', 1) AS fourth, regexp_extract(name, '^20\\d\\d_BTE_\\d+_PRI_\\d+_([A-Z-]+)_', 1) AS own, regexp_extract(name, '^\\d\\d_([A-Z]{{2}})_\\d+_BTE_', 1) AS token FROM n),
g AS (SELECT *, CASE WHEN own <> '' THEN 'agreement' WHEN fourth = 'PE' THEN 'extension' WHEN fourth = 'AA' THEN 'accession' WHEN token <> '' THEN CASE token WHEN 'PR' THEN 'agreement' WHEN 'PE' THEN 'extension' WHEN 'AV' THEN 'notice' WHEN 'AA' THEN 'accession' END END AS family,
CASE WHEN regexp_matches(name, '(^|_)(PE|PCT|PRT)(_|$)') THEN 'extension?' WHEN regexp_matches(name, '(^|_)AA(_|$)') THEN 'accession?' END AS suspect FROM f)"""
_CUST = "SELECT o.*, left(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 20) AS a, left(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g'), 20) AS b FROM orders o JOIN customer ON c_custkey = o_custkey"
_CATALOGUE = f"""i AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderkey % 6 AS t, 'Sindicato ' || o_orderpriority AS union_, CASE o_custkey % 5 WHEN 0 THEN 'Câmara Municipal ' || o_custkey WHEN 1 THEN 'Empresa ' || o_custkey || ', EM' ELSE 'Empresa ' || o_custkey || ', SA' END AS employer FROM orders),
j AS (SELECT *, ['agreement', 'agreement', 'extension', 'notice', 'accession', ''][t + 1] AS family, CASE WHEN k % 4 = 0 THEN 'PRI' WHEN c % 5 = 0 THEN 'APU' WHEN c % 5 = 1 THEN 'SPE' ELSE 'PRI' END AS scope, CASE WHEN k % 5 = 0 THEN '' ELSE 'doc_' || k END AS name,
  CASE k % 3 WHEN 0 THEN '2' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '9' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') ELSE 'C-12' END AS code, CASE WHEN k % 2 = 0 THEN 'CCT.20250708.' || (k % 400) || '/2025' ELSE '' END AS good, k % 50 > 0 AND k % 50 <= k % 70 AS paged FROM i),
l AS (SELECT *, family = 'agreement' AND scope <> 'APU' AS can FROM j),
p AS (SELECT name, CASE WHEN name = '' OR family = 'notice' THEN '' ELSE '1_fontes/irct/' || CASE family WHEN 'agreement' THEN 'convencoes/' || scope WHEN 'extension' THEN 'portarias_extensao' WHEN 'accession' THEN 'acordos_adesao' ELSE 'por_classificar' END || '/' || name || '.pdf' END AS target,
  lpad(CAST(k % 50 AS VARCHAR), 4, '0') || lpad(CAST(k % 70 AS VARCHAR), 4, '0') || '.pdf' AS file, CAST(year(d) AS INTEGER) AS year, CAST(k % 1000 AS INTEGER) AS yearly_no, ['CCT-ALT', 'AE', 'PE', 'AVISO', 'AA', 'ST'][t + 1] AS type, family, CASE WHEN can THEN 'sim' ELSE 'nao' END AS processable, scope, code,
  CASE k % 3 WHEN 0 THEN substr(code, 2) WHEN 1 THEN '' ELSE '12' END AS act, CASE WHEN family = 'agreement' THEN regexp_replace(code, '\\D', '', 'g') WHEN c % 2 = 0 THEN '11111' ELSE '' END AS base_code, CASE WHEN family <> 'agreement' AND c % 2 = 0 THEN '22222; 33333' ELSE '' END AS further_codes,
  CASE WHEN family = 'agreement' THEN '' ELSE '452/2025' END AS order_ref, CAST(k % 52 AS INTEGER) AS issue_no, strftime(d, '%Y-%m-%d') AS issue_date, CAST(CASE WHEN paged THEN k % 50 END AS INTEGER) AS first_page, CAST(CASE WHEN paged THEN k % 70 END AS INTEGER) AS last_page,
  CAST(CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_signatories, CASE WHEN k % 4 = 0 THEN union_ ELSE employer || '; ' || union_ END AS signatories, CASE WHEN good = '' THEN '' ELSE CASE family WHEN 'agreement' THEN 'alters' WHEN 'extension' THEN 'extends' WHEN 'accession' THEN 'joins' ELSE 'mentions' END END AS relation,
  good AS relation_target, good AS structured, CASE WHEN good = '' THEN '' ELSE 'outra' END AS unresolved, '' AS in_force, CASE WHEN k % 3 = 0 THEN 'Transportes' ELSE 'Comércio' END AS subjects, CASE WHEN k % 3 = 0 THEN 'CAE 12' ELSE '' END AS open_sectors, 'https://x/' || k AS url, 'Acordo ' || k AS title,
  CASE WHEN family = 'notice' THEN 'metadado' WHEN name = '' THEN 'por_confirmar' WHEN can THEN 'recolhido' ELSE 'nao_processavel' END AS state, CASE WHEN c % 7 = 0 THEN 'check' ELSE '' END AS warnings, '' AS state_team, '' AS theme, '' AS notes, '' AS responsible, '' AS date_team FROM l)"""
_SHA = "p AS (SELECT page_id, sha256(coalesce(html, '')) AS sha256, octet_length(encode(coalesce(html, ''))) AS bytes, url FROM pages)"


def _run_sql() -> str:
    from .coding import _LINES

    return f"""WITH {_LINES}, a AS (SELECT doc_id, 'low' AS code, line AS text FROM l WHERE regexp_matches(line, '[a-z](###|&&&|%%%|!!)') UNION ALL SELECT doc_id, 'toxic', line FROM l WHERE regexp_matches(lower(line), 'idiot|moron|loser|stupid|scum')),
g AS (SELECT DISTINCT doc_id, 'low' AS code FROM labels JOIN documents USING (doc_id) WHERE quality = 0 UNION SELECT DISTINCT doc_id, 'toxic' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1), d AS (SELECT DISTINCT doc_id, code FROM a)"""


ORACLE_SQL = {
    "name_families": f"WITH {_NAMES} SELECT o_orderkey, family, suspect FROM g",
    "refused_files": f"WITH {_NAMES}, r AS (SELECT CASE WHEN starts_with(name, 'bte') THEN 'whole issue' WHEN coalesce(family, suspect) <> 'agreement' THEN coalesce(family, suspect) END AS reason FROM g) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason",
    "resolved_subtypes": f"WITH {_NAMES}, t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'AE-RECT' WHEN 1 THEN 'AE' ELSE coalesce(nullif(own, ''), CASE WHEN fourth IN ('PE', 'AA') THEN fourth END, nullif(token, ''), '') END AS type FROM g) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'revisao_parcial' WHEN contains(type, 'RECT') THEN 'correction' ELSE 'unknown' END AS subtype, type FROM t",
    "entries_to_name": "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 4 IN (0, 3) AND o_custkey % 4 IN (0, 2) AND o_orderstatus <> 'P'",
    "long_names": f"""WITH o AS ({_CUST}), h AS (SELECT *, printf('%04d_BTE_%02d_', year(o_orderdate), o_orderkey % 52) AS head, printf('_%03d', o_orderkey % 1000) AS seq, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE '2' || printf('%04d', o_orderkey % 10000) END AS code, CASE WHEN o_custkey % 3 > 0 THEN '+' || (o_custkey % 3) ELSE '' END AS tail FROM o),
p AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN head || 'PRI' || seq || '_CCT-ALT_' || CASE WHEN code = '' THEN '0' ELSE code END || '_' WHEN 3 THEN head || 'AVISO' || seq || '_' || CASE WHEN code = '' THEN '0' ELSE code END || '_' WHEN 1 THEN CASE WHEN code <> '' THEN head || 'PE' || seq || printf('_%04d', o_orderkey % 500) || CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE '' END || '-2025_' || code || '_' END ELSE CASE WHEN code <> '' THEN head || 'AA' || seq || '_' || code || '_' END END AS pre FROM h),
q AS (SELECT *, pre || a || '-' || b || tail AS whole, 63 - length(pre) - length(tail) - 1 AS room FROM p)
SELECT o_orderkey, CASE WHEN length(whole) <= 63 THEN whole WHEN room >= 6 THEN pre || left(a, room // 2) || '-' || left(b, room // 2) || tail END AS name FROM q""",
    "short_names": f"""WITH o AS ({_CUST}), p AS (SELECT o_orderkey, a, b || 'ABCDEFGHIJKLMNOPQRST' || a AS z, lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '_' || ['PR', 'PE', 'AA', 'AV'][o_orderkey % 4 + 1] || '_' || printf('%03d', o_orderkey % 1000) || '_BTE_' || printf('%02d', o_orderkey % 52) AS pre FROM o),
q AS (SELECT *, greatest(4, (63 - length(pre) - 2) // 2) AS each FROM p) SELECT o_orderkey, CASE WHEN length(pre) + length(a) + length(z) + 2 <= 63 THEN pre || '_' || a || '_' || z ELSE pre || '_' || left(a, each) || '_' || left(z, each) END AS name FROM q""",
    "base_acronyms": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'ACE' WHEN 4 THEN 'SNM2' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'ABC' || s_suppkey ELSE 'Motoristas' END END AS acronym, CASE s_suppkey % 5 WHEN 0 THEN 'registry' WHEN 4 THEN 'registry' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'derived' ELSE 'fallback' END END AS source FROM supplier",
    "catalogue_projection": f"WITH {_CATALOGUE} SELECT * FROM p",
    "catalogue_counts": f"""WITH {_CATALOGUE}, r AS (SELECT * REPLACE (CASE WHEN yearly_no = 7 THEN 'same ' || issue_no ELSE name END AS name) FROM p)
SELECT 'family' AS what, CASE WHEN family = '' THEN 'por_classificar' ELSE family END AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'scope', scope, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'collision', name, count(*) FROM r WHERE name <> '' GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'processable', '', count(*) FROM r WHERE processable = 'sim' UNION ALL SELECT 'warned', '', count(*) FROM r WHERE warnings <> '' UNION ALL SELECT 'open sectors', '', count(*) FROM r WHERE open_sectors <> '' UNION ALL SELECT 'unnamed', '', count(*) FROM r WHERE name = ''""",
    "stored_files": f"""WITH {_SHA}, h AS (SELECT sha256, bytes, min(printf('f%08d', page_id)) AS path FROM p WHERE page_id % 3 > 0 GROUP BY ALL)
SELECT page_id, path, CASE WHEN path IS NOT NULL THEN 'copied' WHEN page_id % 7 = 0 OR coalesce(url, '') = '' THEN 'missing: no URL' ELSE 'missing: to download' END AS state FROM p LEFT JOIN h USING (sha256, bytes)""",
    "urls_by_content": f"""WITH {_SHA}, k AS (SELECT sha256, arg_max(url, page_id) AS u FROM p WHERE page_id % 2 = 0 AND coalesce(url, '') <> '' GROUP BY sha256), m AS (SELECT page_id, sha256, CASE WHEN page_id % 3 > 0 THEN nullif(url, '') END AS url FROM p)
SELECT page_id, coalesce(url, u) AS url, url IS NULL AND u IS NOT NULL AS added FROM m LEFT JOIN k USING (sha256)""",
    "corpus_states": "SELECT page_id AS name, CASE WHEN page_id % 4 = 0 THEN 'absent' WHEN page_id % 9 = 0 THEN 'error' ELSE 'measured' END AS state, CASE WHEN page_id % 4 > 0 AND page_id % 9 = 0 THEN 'ValueError: no text' END AS error, CAST(CASE WHEN page_id % 4 > 0 AND page_id % 9 > 0 THEN length(html) END AS INTEGER) AS n_chars FROM pages",
    "further_gain": f"""{_run_sql()}, s AS (SELECT coalesce(d.code, g.code) AS code, d.doc_id IS NOT NULL AS in_d, g.doc_id IS NOT NULL AS in_g, d.doc_id % 3 = 0 AS late FROM d FULL JOIN g ON d.doc_id = g.doc_id AND d.code = g.code)
SELECT code, count(*) FILTER (WHERE in_d AND in_g) AS tp, count(*) FILTER (WHERE in_d AND NOT in_g) AS fp, count(*) FILTER (WHERE in_d AND in_g AND late) AS new_tp, count(*) FILTER (WHERE in_d AND NOT in_g AND late) AS new_fp FROM s GROUP BY code""",
    "already_complete": f"{_run_sql()} SELECT DISTINCT doc_id FROM g WHERE doc_id NOT IN (SELECT g.doc_id FROM g LEFT JOIN d ON d.doc_id = g.doc_id AND d.code = g.code AND d.doc_id % 3 > 0 WHERE d.doc_id IS NULL)",
    "rejoined_pages": """WITH t AS (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS text FROM documents), n AS (SELECT doc_id, text, (length(text) - 1) // 40 AS last FROM t WHERE length(text) > 0), p AS (SELECT doc_id, text, last, unnest(range(0, last + 1)) AS page FROM n)
SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN page = 0 THEN left(text, 40) || CASE WHEN last > 0 THEN substr(text, 41, 40) ELSE '-' END WHEN page < last THEN substr(text, (page + 1) * 40 + 1, 40) ELSE '-' END AS text FROM p""",
    "longest_fragments": r"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS place, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, place, CAST(len(regexp_extract_all(line, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS INTEGER) AS n_words FROM l)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, place, n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, place) AS rank FROM w WHERE n_words >= 4) x WHERE rank <= 12""",
    "label_types": rf"""WITH k AS (SELECT {_sql_pick('o_orderkey', ['', 'Anexo' + chr(92), 'Texto' + chr(92)])} AS pre, {_sql_pick('o_custkey', ['PREÂMBULO', 'Cláusula 1.ª', 'Artigo 2.º - X', 'Capítulo I', 'Secção II', 'Anexo A', 'Nota', ' Clausula 3'])} AS own, o_orderstatus AS st FROM orders)
SELECT pre || own || st AS label, CASE WHEN regexp_matches(trim(own), '^PRE') THEN 'preamble' WHEN regexp_matches(trim(own), '^Cl') THEN 'clause' WHEN starts_with(own, 'Artigo') THEN 'article' WHEN starts_with(own, 'Cap') THEN 'chapter' WHEN starts_with(own, 'Sec') THEN 'section' WHEN starts_with(own, 'Anexo') OR starts_with(pre, 'Anexo') THEN 'annex' ELSE 'block' END AS type, count(*) AS n FROM k GROUP BY ALL""",
}
