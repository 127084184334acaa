"""Queries of registry, catalogue, lookups, windows and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import acronyms, catalogue, evaluation, lines, lookup, registry
from .common import table

KEYS = ["lavender", "blush thistle", "royal", "medium", "dark slate", "antique", "forest brown", "chartreuse"]


def stable_ordinals(spark, sf_dir):
    """Orders by year and priority: those with status F hold a number already, the place of their key."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 1000 + 1).alias("assigned"))
    return registry.ordinals(o, ["year", "o_orderpriority"], "assigned", ["o_custkey", "o_orderkey"]).select("o_orderkey", "ordinal")


def last_write_wins(spark, sf_dir):
    return registry.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"), "props"), ["user_id", "event_type"], "event_id")


def first_write_wins(spark, sf_dir):
    return registry.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], "event_id")


def registry_upsert(spark, sf_dir):
    """Events of a user, folded in order: an empty value (props of views, here blank) never erases an earlier one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "view", "").otherwise(F.col("props")).alias("props"))
    return registry.fold_values(e, ["user_id"], "event_id", ["event_type", "props"])


def upsert_merge(spark, sf_dir):
    """Two snapshots of nations and suppliers by name length: new values replace old ones unless blank."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    new = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") < 5, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey"))).alias("segment"), F.lit(None).cast("string").alias("name"))
    return registry.upsert(old, new, ["key"])


def download_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    state = registry.download_state(F.col("event_type") != "view", F.when(F.col("user_id") % 7 == 0, "").otherwise("u"), F.col("value") > 100, k % 5 != 0, F.when(k % 3 == 0, 304).when(k % 3 == 1, 200).otherwise(404), k % 2 == 0)
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def reference_resolution(spark, sf_dir):
    """Line items refer to orders by customer and day: resolved where exactly one order has that customer and day."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    refs = table(spark, sf_dir, "lineitem").join(o.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("cust"), F.col("day").alias("on"))
    return lookup.exactly_one(refs, ["cust", "on"], o, ["o_custkey", "day"], "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


def base_resolution(spark, sf_dir):
    """Orders as registry entries: priority 5-LOW extends earlier agreements named in its chain."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "CCT").when(F.col("o_orderpriority") == "2-HIGH", "AE").when(F.col("o_orderpriority") == "3-MEDIUM", "ACT").otherwise("PE")
    number = F.col("o_orderkey") % 2000
    ref = lambda d: F.concat(F.element_at(F.array(F.lit("CCT"), F.lit("AE"), F.lit("ACT")), ((F.col("o_orderkey") + d) % 3 + 1).cast("int")), F.lit(".20250101."), (F.col("o_orderkey") + d) % 2000, F.lit("/"), F.year("o_orderdate"))
    e = o.select(F.col("o_orderkey").alias("key"), registry.family(kind).alias("family"), kind.alias("type"), F.concat(number, F.lit("/"), F.year("o_orderdate")).alias("id"), F.concat(F.lit("C"), F.col("o_orderkey")).alias("code"), F.concat(ref(1), F.lit("; "), ref(7)).alias("chain"))
    return registry.resolve_base(e).filter("family <> 'agreement'").select("key", "base_codes", "unresolved")


def notice_to_order(spark, sf_dir):
    """Errors of a user as notices to their later purchases: the last one and how many."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type")
    out = lookup.earlier_matches(e.filter("event_type = 'purchase'").select("user_id", "at", "event_id"), e.filter("event_type = 'error'").select("user_id", "at", F.col("event_id").alias("nid")), ["user_id"], "at", "nid")
    return out.select("event_id", "latest", "n_notices")


def _snapshots(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select(F.concat(F.col("c_custkey") % 1400).cast("string").alias("year"), F.lit("").alias("yearly_no"), F.lit("").alias("issue_no"), F.col("c_mktsegment").alias("type"), F.lit("").alias("file"), F.lit("").alias("url"), F.lit("").alias("title"), F.concat(F.lit("n"), F.col("c_custkey") % 1450).alias("name"), "c_custkey", "c_nationkey", "c_acctbal")
    blank = [F.lit("").alias(t) for t in catalogue.TEAM]
    new = base.filter("c_acctbal > -500").select(*catalogue.IDENTITY, "name", *blank, F.lit("recolhido").alias("state"), F.col("c_custkey").cast("string").alias("ref"))
    old = base.filter("c_acctbal < 5000").select(*catalogue.IDENTITY, "name", F.lit("").alias("state_team"), F.lit("").alias("theme"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("note "), F.col("c_custkey"))).otherwise("").alias("notes"), F.lit("").alias("responsible"), F.lit("").alias("date_team"), F.when(F.col("c_nationkey") % 5 == 0, "revisto").otherwise("recolhido").alias("state"), F.col("c_custkey").cast("string").alias("ref"))
    return new, old


def catalog_merge(spark, sf_dir):
    merged = catalogue.merge(*_snapshots(spark, sf_dir))
    return merged.select("year", "type", "name", "notes", "state", "ref", "warning")


def catalog_orphans(spark, sf_dir):
    return catalog_merge(spark, sf_dir).filter(F.col("warning") == catalogue.ORPHAN).select("ref", "name")


def name_composition(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    prefix = F.format_string("%04d_BTE_%02d_PRI_%03d_CCT_%d_", F.year("o_orderdate"), F.weekofyear("o_orderdate"), F.col("o_orderkey") % 1000, F.col("o_orderkey"))
    parts = F.array(fx.acronym("c_name", 20), fx.acronym("c_mktsegment", 20))
    return o.select("o_orderkey", registry.compose_name(prefix, parts, F.col("o_custkey") % 3).alias("name"))


def family_case(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("CCT-ALT", "ACTV", "ACT", "aviso de projeto", "Av.", "AA", "PE", "PCT", "Prt", "AE-RECT", "ST", "dá", "ACEP")]), (F.col("o_orderkey") % 13 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(kinds.alias("kind")).agg(F.count("*").alias("n")).select("kind", registry.family("kind").alias("family"), "n")


def page_range(spark, sf_dir):
    stem = F.concat(F.lpad((F.col("page_id") % 50).cast("string"), 4, "0"), F.lpad((F.col("page_id") % 70).cast("string"), 4, "0"))
    first, last = catalogue.page_range("stem")
    return table(spark, sf_dir, "pages").select("page_id", stem.alias("stem")).select("page_id", first.alias("first"), last.alias("last"))


def registry_keys(spark, sf_dir):
    """Derived year, issue, file and key of pages, from cells that are often blank and their URL."""
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "2025.0").otherwise("").alias("year"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") % 52).cast("string")).otherwise("").alias("issue_no"), F.lit("").alias("file"), F.concat(F.lit("https://bulletin.example/docs/2024/31/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".pdf?x=1")).alias("url"), F.lit("").alias("id"), F.lit("").alias("title"))
    return registry.complete(p).select("page_id", "year", "issue_no", "file", "key")


def sector_split(spark, sf_dir):
    subjects, candidates = catalogue.split_sectors(F.concat_ws(";", F.regexp_replace("p_type", " ", ";"), F.lit("BRASS"), F.col("p_type")), ["brass", "steel", "plated"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(subjects, "; ").alias("subjects"), F.array_join(candidates, "; ").alias("candidates"))


def alteration_split(spark, sf_dir):
    chain = F.concat(F.lit("CCT.20250708."), F.col("event_id") % 400, F.lit("/2025; "), F.col("event_type"), F.lit("; AE-ALT.20240101.7/2024"))
    good, bad = catalogue.split_chain("chain")
    verb, targets = catalogue.relation(F.when(F.col("event_type") == "view", "extension").when(F.col("event_type") == "error", "accession").otherwise("agreement"), good, bad)
    return table(spark, sf_dir, "events").select("event_id", "event_type", chain.alias("chain")).select("event_id", F.array_join(good, "; ").alias("structured"), F.array_join(bad, "; ").alias("unresolved"), verb.alias("relation"), targets.alias("targets"))


def _keys(spark):
    return spark.createDataFrame([(k, k.upper()[:4], i) for i, k in enumerate(KEYS)] + [("medium", "later", 99)], "key string, value string, ord int")


def longest_containment(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return lookup.lookup(names, "name", _keys(spark).filter("length(key) >= 6"), 6).select("p_partkey", "key", "value")


def first_containment(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return lookup.lookup(names, "name", _keys(spark).filter("length(key) >= 6"), 6, longest=False).select("p_partkey", "key", "value")


def prefix_boundary_join(spark, sf_dir):
    name = F.concat(F.lit("2025_BTE_31_PRI_000_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("_"), F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer")
    left = c.select(name.alias("doc"))
    right = c.select(F.left(name, (F.lit(24) + F.col("c_custkey") % 12).cast("int")).alias("cut"), "c_custkey")
    return lookup.prefix_lookup(left, "doc", right, "cut", "c_custkey").select("doc", "cut")


def earlier_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"))
    return registry.earlier_names(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "name").select("o_orderkey", "previous", "n_earlier")


def number_jumps(spark, sf_dir):
    return lines.number_jumps(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 4).alias("num")), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "num")


def forward_fill(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return lines.forward_fill(t, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user").select("conv_id", "turn", "last_user")


def context_chain(spark, sf_dir):
    """Region, nation and supplier as one forest: the chain of labels above each node."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("label"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("up"), F.col("n_name").alias("label"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("up"), F.col("s_name").alias("label"))
    return lookup.parents(r.unionByName(n).unionByName(s), "id", "up", "label").select("id", "chain")


def forest_descendants(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("up"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("up"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("up"))
    return lookup.descendants(r.unionByName(n).unionByName(s), "id", "up", r.select("id")).groupBy("root").agg(F.count("*").alias("n"))


def _orgs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    base = F.concat(F.lit("S"), F.chr(65 + F.col("s_nationkey") % 26))
    return s.select(F.concat_ws(".", F.col("s_suppkey") % 7 + 1, F.col("s_suppkey"), F.lit(0)).alias("code"), F.concat(F.lit("Sindicato dos "), F.col("s_name")).alias("name"), base.alias("base"), F.lit("Lisboa").alias("municipality"), F.lit("2025").alias("last_activity"))


def ambiguous_acronyms(spark, sf_dir):
    return acronyms.ambiguous(_orgs(spark, sf_dir))


def acronym_assignment(spark, sf_dir):
    return acronyms.assign(_orgs(spark, sf_dir))


def act_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"))


def perf_aggregate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.lit(1).alias("pages"), F.round("value", 3).cast("decimal(18,3)").alias("seconds"), F.round("value", 1).alias("start_s"), F.col("user_id").alias("rss_mb"))
    out = evaluation.performance(e, ["event_type"])
    return out.select("event_type", "n", "pages", F.round(F.col("seconds_per_page").cast("double"), 6).alias("seconds_per_page"), "start_up", "peak_mb")


def regression_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    metric = lambda df, shift: df.select("source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in (("docs", F.col("n") + shift), ("chars", F.col("c") - shift * 40), ("langs", F.col("l") * 1.0))])).alias("x")).select("source", "x.metric", F.col("x.value").cast("double").alias("value"))
    per = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"), F.count_distinct("lang").alias("l"))
    shift = F.length("source") - 4
    return evaluation.gate(metric(per, shift), metric(per, F.lit(0)), ["source"], {"docs": ("+", 0), "chars": ("-", 20), "langs": ("=", 0)})


def inventory_by_class(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kind = F.when(F.contains("url", F.lit("/en/")), "english").when(F.contains("url", F.lit("/fr/")), "french").when(F.startswith("url", F.lit("https://")), "secure").otherwise("other")
    return p.groupBy(kind.alias("class")).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("html")).alias("n_bytes"))


def content_hash(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("size_bytes"), F.sha2("html", 256).alias("sha256"))
    return p.groupBy("size_bytes", "sha256").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def manifest_check(spark, sf_dir):
    """Pages against a manifest that lacks some and has others' hashes: missing, altered and extra files."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("sha"))
    listed = p.filter("path % 10 <> 3").select(F.when(F.col("path") % 10 == 4, F.col("path") + 1000000).otherwise(F.col("path")).alias("path"), F.when(F.col("path") % 10 == 5, "x").otherwise(F.col("sha")).alias("listed"))
    both = p.join(listed, "path", "full_outer")
    state = F.when(F.col("sha").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("sha") != F.col("listed"), "altered").otherwise("ok")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def earlier_dedupe(spark, sf_dir):
    """First-seen values of each user's events, in order."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])), "; ").alias("types"))


QUERIES = {f.__name__: f for f in (
    stable_ordinals, last_write_wins, first_write_wins, registry_upsert, upsert_merge, download_states, reference_resolution, base_resolution, notice_to_order, catalog_merge, catalog_orphans, name_composition,
    family_case, page_range, registry_keys, sector_split, alteration_split, longest_containment, first_containment, prefix_boundary_join, earlier_names, number_jumps, forward_fill, context_chain, forest_descendants,
    ambiguous_acronyms, acronym_assignment, act_history, perf_aggregate, regression_gate, inventory_by_class, content_hash, manifest_check, earlier_dedupe,
)}

_K = "k(key, value, ord) AS (VALUES " + ", ".join(f"('{k}', '{k.upper()[:4]}', {i})" for i, k in enumerate(KEYS)) + ", ('medium', 'later', 99)), kk AS (SELECT key, arg_min(value, ord) AS value, min(ord) AS ord FROM k WHERE length(key) >= 6 GROUP BY key)"
_MERGE = """WITH c AS (SELECT CAST(c_custkey % 1400 AS VARCHAR) AS year, c_mktsegment AS type, 'n' || (c_custkey % 1450) AS name, c_custkey, c_nationkey, c_acctbal FROM customer),
nw AS (SELECT year, type, name, year || '|' || type AS id, CAST(c_custkey AS VARCHAR) AS ref FROM c WHERE c_acctbal > -500),
od0 AS (SELECT year, type, name, year || '|' || type AS id, CAST(c_custkey AS VARCHAR) AS ref, CASE WHEN c_nationkey % 3 = 0 THEN 'note ' || c_custkey ELSE '' END AS notes, CASE WHEN c_nationkey % 5 = 0 THEN 'revisto' ELSE 'recolhido' END AS state FROM c WHERE c_acctbal < 5000),
ni AS (SELECT id, count(*) AS cn FROM nw GROUP BY id),
od AS (SELECT od0.* FROM od0 LEFT JOIN ni USING (id) WHERE ni.id IS NULL OR notes <> '' OR state = 'revisto'),
oi AS (SELECT id, count(*) AS co FROM od GROUP BY id),
b1 AS (SELECT id, cn = 1 AND co = 1 AS one FROM ni JOIN oi USING (id)),
n1 AS (SELECT nw.* FROM nw WHERE id NOT IN (SELECT id FROM b1)), o1 AS (SELECT * FROM od WHERE id NOT IN (SELECT id FROM b1)),
b2 AS (SELECT name, cn = 1 AND co = 1 AS one FROM (SELECT name, count(*) AS cn FROM n1 GROUP BY name) x JOIN (SELECT name, count(*) AS co FROM o1 GROUP BY name) y USING (name)),
res AS (
  SELECT nw.year, nw.type, nw.name, coalesce(nullif(o.notes, ''), '') AS notes, CASE WHEN o.state = 'revisto' THEN o.state ELSE 'recolhido' END AS state, nw.ref, NULL AS w FROM nw JOIN b1 USING (id) JOIN od o USING (id) WHERE one
  UNION ALL SELECT nw.year, nw.type, nw.name, '', 'recolhido', nw.ref, 'R' FROM nw JOIN b1 USING (id) WHERE NOT one
  UNION ALL SELECT o.year, o.type, o.name, o.notes, o.state, o.ref, 'R' FROM od o JOIN b1 USING (id) WHERE NOT one
  UNION ALL SELECT n1.year, n1.type, n1.name, o1.notes, CASE WHEN o1.state = 'revisto' THEN o1.state ELSE 'recolhido' END, n1.ref, CASE WHEN cn > 1 THEN 'R' END FROM n1 JOIN b2 USING (name) JOIN o1 USING (name) JOIN ni ON ni.id = n1.id WHERE one
  UNION ALL SELECT n1.year, n1.type, n1.name, '', 'recolhido', n1.ref, 'R' FROM n1 JOIN b2 USING (name) WHERE NOT one
  UNION ALL SELECT o1.year, o1.type, o1.name, o1.notes, o1.state, o1.ref, 'R' FROM o1 JOIN b2 USING (name) WHERE NOT one
  UNION ALL SELECT n1.year, n1.type, n1.name, '', 'recolhido', n1.ref, CASE WHEN cn > 1 THEN 'R' END FROM n1 JOIN ni USING (id) WHERE name NOT IN (SELECT name FROM b2)
  UNION ALL SELECT year, type, name, notes, state, ref, 'O' FROM o1 WHERE name NOT IN (SELECT name FROM b2)
)"""
_WARN = f"CASE w WHEN 'R' THEN '{catalogue.REPEATED}' WHEN 'O' THEN '{catalogue.ORPHAN}' END"
_DAY = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"

ORACLE_SQL = {
    "stable_ordinals": """WITH o AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 1000 + 1 END AS a FROM orders), m AS (SELECT *, coalesce(max(a) OVER (PARTITION BY y, p), 0) AS top FROM o)
SELECT o_orderkey, CAST(a AS BIGINT) AS ordinal FROM o WHERE a IS NOT NULL UNION ALL SELECT o_orderkey, CAST(top + row_number() OVER (PARTITION BY y, p ORDER BY o_custkey, o_orderkey) AS BIGINT) FROM m WHERE a IS NULL""",
    "last_write_wins": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(round(value, 6), event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type",
    "first_write_wins": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY user_id, event_type",
    "registry_upsert": "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) FILTER (WHERE event_type <> 'view' AND props <> '') AS props FROM events GROUP BY user_id",
    "upsert_merge": "SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 AND c_nationkey >= 5 THEN 'N' || c_nationkey ELSE c_mktsegment END AS segment, c_name AS name FROM customer",
    "download_states": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT CASE WHEN event_type = 'view' THEN 'ignorado' WHEN user_id % 7 = 0 THEN 'falhado' WHEN value > 100 THEN 'ja_existente' WHEN k % 5 = 0 THEN 'por_descarregar' WHEN k % 3 = 0 THEN 'inalterado' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'descarregado' ELSE 'falhado' END AS state, count(*) AS n FROM e GROUP BY 1""",
    "reference_resolution": """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders), u AS (SELECT o_custkey, day, min(o_orderkey) AS k FROM o GROUP BY 1, 2 HAVING count(*) = 1)
SELECT u.k AS o_orderkey, count(*) AS n FROM lineitem JOIN o ON o.o_orderkey = l_orderkey LEFT JOIN u ON u.o_custkey = o.o_custkey AND u.day = o.day GROUP BY u.k""",
    "base_resolution": """WITH e AS (SELECT o_orderkey AS key, year(o_orderdate) AS y, o_orderkey % 2000 AS num, CASE o_orderpriority WHEN '1-URGENT' THEN 'CCT' WHEN '2-HIGH' THEN 'AE' WHEN '3-MEDIUM' THEN 'ACT' ELSE 'PE' END AS kind FROM orders),
u AS (SELECT num, y, kind, min('C' || key) AS code FROM e WHERE kind <> 'PE' GROUP BY 1, 2, 3 HAVING count(*) = 1),
r AS (SELECT key, y, t.d, (key + t.d) % 2000 AS num, ['CCT', 'AE', 'ACT'][(key + t.d) % 3 + 1] AS kind FROM e, (VALUES (1), (7)) t(d) WHERE e.kind = 'PE'),
j AS (SELECT key, d, code FROM r LEFT JOIN u USING (num, y, kind)), g AS (SELECT key, max(code) FILTER (WHERE d = 1) AS a, max(code) FILTER (WHERE d = 7) AS b, CAST(count(*) FILTER (WHERE code IS NULL) AS INTEGER) AS unresolved FROM j GROUP BY key)
SELECT key, CASE WHEN a IS NULL THEN coalesce(b, '') WHEN b IS NULL OR a = b THEN a ELSE a || '; ' || b END AS base_codes, unresolved FROM g""",
    "notice_to_order": f"""WITH e AS (SELECT event_id, user_id, {_DAY} AS at, event_type FROM events)
SELECT p.event_id, last(CAST(n.event_id AS VARCHAR) ORDER BY n.at, CAST(n.event_id AS VARCHAR)) AS latest, count(n.event_id) AS n_notices FROM e p LEFT JOIN e n ON n.event_type = 'error' AND n.user_id = p.user_id AND n.at <= p.at WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
    "catalog_merge": f"{_MERGE} SELECT year, type, name, notes, state, ref, {_WARN} AS warning FROM res",
    "catalog_orphans": f"{_MERGE} SELECT ref, name FROM res WHERE w = 'O'",
    "name_composition": """WITH p AS (SELECT o_orderkey, printf('%04d_BTE_%02d_PRI_%03d_CCT_%d_', year(o_orderdate), week(o_orderdate), o_orderkey % 1000, o_orderkey) AS pre, left(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 20) AS a, left(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g'), 20) AS b, CASE WHEN o_custkey % 3 > 0 THEN '+' || (o_custkey % 3) ELSE '' END AS tail FROM orders JOIN customer ON c_custkey = o_custkey),
q AS (SELECT *, pre || a || '-' || b || tail AS whole, (63 - length(pre) - length(tail) - 1) // 2 AS each, 63 - length(pre) - length(tail) - 1 AS room FROM p)
SELECT o_orderkey, CASE WHEN length(whole) <= 63 THEN whole WHEN room >= 6 THEN pre || left(a, each) || '-' || left(b, each) || tail END AS name FROM q""",
    "family_case": """SELECT ['CCT-ALT', 'ACTV', 'ACT', 'aviso de projeto', 'Av.', 'AA', 'PE', 'PCT', 'Prt', 'AE-RECT', 'ST', 'dá', 'ACEP'][o_orderkey % 13 + 1] AS kind,
['agreement', 'agreement', 'agreement', 'notice', 'notice', 'accession', 'extension', 'extension', 'extension', 'agreement', NULL, 'agreement', 'agreement'][o_orderkey % 13 + 1] AS family, count(*) AS n FROM orders GROUP BY ALL""",
    "page_range": "SELECT page_id, CAST(CASE WHEN page_id % 50 > 0 AND page_id % 50 <= page_id % 70 THEN page_id % 50 END AS INTEGER) AS first, CAST(CASE WHEN page_id % 50 > 0 AND page_id % 50 <= page_id % 70 THEN page_id % 70 END AS INTEGER) AS last FROM pages",
    "registry_keys": """WITH p AS (SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 2025 ELSE 2024 END AS INTEGER) AS year, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 52 ELSE 31 END AS INTEGER) AS issue_no, lpad(CAST(page_id AS VARCHAR), 8, '0') AS stem FROM pages)
SELECT page_id, year, issue_no, stem || '.pdf' AS file, year || '/' || issue_no || '/' || stem AS key FROM p""",
    "sector_split": """WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ';') || ';BRASS;' || p_type, ';'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part),
d AS (SELECT p_partkey, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS parts FROM p)
SELECT p_partkey, array_to_string(list_filter(parts, lambda x: NOT regexp_matches(lower(x), 'brass|steel|plated')), '; ') AS subjects, array_to_string(list_filter(parts, lambda x: regexp_matches(lower(x), 'brass|steel|plated')), '; ') AS candidates FROM d""",
    "alteration_split": """SELECT event_id, 'CCT.20250708.' || (event_id % 400) || '/2025; AE-ALT.20240101.7/2024' AS structured, event_type AS unresolved, CASE event_type WHEN 'view' THEN 'extends' WHEN 'error' THEN 'joins' ELSE 'alters' END AS relation, 'CCT.20250708.' || (event_id % 400) || '/2025; AE-ALT.20240101.7/2024; ' || event_type AS targets FROM events""",
    "longest_containment": f"WITH {_K}, f AS (SELECT p_partkey, key, value, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, ord) AS r FROM part JOIN kk ON contains(lower(p_name), key)) SELECT p_partkey, f.key, f.value FROM part LEFT JOIN (SELECT * FROM f WHERE r = 1) f USING (p_partkey)",
    "first_containment": f"WITH {_K}, f AS (SELECT p_partkey, key, value, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS r FROM part JOIN kk ON contains(lower(p_name), key)) SELECT p_partkey, f.key, f.value FROM part LEFT JOIN (SELECT * FROM f WHERE r = 1) f USING (p_partkey)",
    "prefix_boundary_join": """WITH c AS (SELECT '2025_BTE_31_PRI_000_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '_' || c_mktsegment AS doc, CAST(24 + c_custkey % 12 AS INTEGER) AS n, c_custkey FROM customer), r AS (SELECT left(doc, n) AS cut, c_custkey FROM c),
j AS (SELECT doc, cut, row_number() OVER (PARTITION BY doc ORDER BY length(cut) DESC, r.c_custkey) AS k FROM c JOIN r ON starts_with(doc, cut) AND (length(doc) = length(cut) OR substr(doc, length(cut) + 1, 1) = '_'))
SELECT c.doc, j.cut FROM c LEFT JOIN j ON j.doc = c.doc AND j.k = 1""",
    "earlier_names": "SELECT o_orderkey, lag('o' || o_orderkey) OVER w AS previous, row_number() OVER w - 1 AS n_earlier FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "number_jumps": "SELECT l_orderkey, CAST(sum(CASE WHEN b IS NOT NULL AND num <> b + 1 THEN 1 ELSE 0 END) AS BIGINT) AS jumps FROM (SELECT l_orderkey, l_partkey % 4 AS num, lag(l_partkey % 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) x GROUP BY l_orderkey",
    "forward_fill": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations",
    "context_chain": """SELECT 'r' || r_regionkey AS id, '' AS chain FROM region UNION ALL SELECT 'n' || n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 's' || s_suppkey, r_name || ' > ' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "forest_descendants": "SELECT 'r' || n_regionkey AS root, count(DISTINCT n_nationkey) + count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey",
    "ambiguous_acronyms": "WITH o AS (SELECT 'S' || chr(CAST(65 + s_nationkey % 26 AS INTEGER)) AS acronym, (s_suppkey % 7 + 1) || '.' || s_suppkey AS l, 'Sindicato dos ' || s_name AS name FROM supplier) SELECT acronym, count(DISTINCT l) AS n_lineages, string_agg(DISTINCT name, ' | ' ORDER BY name) AS names FROM o GROUP BY acronym HAVING count(DISTINCT l) > 1",
    "act_history": "SELECT o_custkey, count(*) AS n, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey",
    "perf_aggregate": "SELECT event_type, count(*) AS n, count(*) AS pages, round(CAST(sum(CAST(round(value, 3) AS DECIMAL(18,3))) AS DOUBLE) / count(*), 6) AS seconds_per_page, median(round(value, 1)) AS start_up, max(user_id) AS peak_mb FROM events GROUP BY event_type",
    "regression_gate": """WITH p AS (SELECT source, count(*) AS n, sum(n_chars) AS c, count(DISTINCT lang) AS l, length(source) - 4 AS s FROM documents GROUP BY source)
SELECT source, 'docs' AS metric, n::DOUBLE AS before, (n + s)::DOUBLE AS now, CASE WHEN s < 0 THEN 'REGRESSION' WHEN s > 0 THEN 'improved' ELSE 'same' END AS state FROM p
UNION ALL SELECT source, 'chars', c::DOUBLE, (c - s * 40)::DOUBLE, CASE WHEN -s * 40 > 20 THEN 'REGRESSION' WHEN s > 0 THEN 'improved' ELSE 'same' END FROM p
UNION ALL SELECT source, 'langs', l::DOUBLE, l::DOUBLE, 'same' FROM p""",
    "inventory_by_class": "SELECT CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/fr/') THEN 'french' WHEN starts_with(url, 'https://') THEN 'secure' ELSE 'other' END AS class, count(*) AS n_files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS n_bytes FROM pages GROUP BY 1",
    "content_hash": "SELECT CAST(octet_length(encode(html)) AS INTEGER) AS size_bytes, sha256(html) AS sha256, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1, 2",
    "earlier_dedupe": "SELECT user_id, string_agg(event_type, '; ' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type) x GROUP BY user_id",
    "manifest_check": "WITH s AS (SELECT CASE page_id % 10 WHEN 3 THEN 'extra' WHEN 4 THEN 'extra' WHEN 5 THEN 'altered' ELSE 'ok' END AS state FROM pages UNION ALL SELECT 'missing' FROM pages WHERE page_id % 10 = 4) SELECT state, count(*) AS n FROM s GROUP BY state",
}
