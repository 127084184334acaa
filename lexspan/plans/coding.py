"""Queries of coding, triage and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding, evaluation, lines
from .common import SQL_LINES, table

#: A small codebook that matches the test tables: license lines, German and French function words, toxic words.
BOOK = coding.Codebook(
    (
        coding.Code("1.1", ("license", "licensed"), name="licensing"),
        coding.Code("1.2", ("copyright", "rights reserved", "released under"), requires_any=("license", "rights"), name="rights"),
        coding.Code("2.1", ("der", "und"), requires_any=("die",), excludes=("the",), name="german"),
        coding.Code("2.2", ("les", "dans", "avec"), excludes=("the", "der"), name="french"),
        coding.Code("3.1", ("idiot", "moron", "loser", "stupid"), name="insults"),
    ),
    axes=("1", "2", "3"),
)


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


SQL_BOOK = "book(ord, code, terms, requires_any, excludes) AS (VALUES " + ", ".join(f"({k}, '{c.code}', {_list(c.terms)}, {_list(c.requires_any)}, {_list(c.excludes)})" for k, c in enumerate(BOOK.codes)) + ")"


def sql_coded(source: str, key: str, span: str, conditions: bool = True) -> str:
    """A SELECT of (key, ord, code, hits) of spans that the book's codes match."""
    more = f"AND (len(requires_any) = 0 OR len(list_filter(requires_any, lambda t: contains(lower({span}), t))) > 0) AND len(list_filter(excludes, lambda t: contains(lower({span}), t))) = 0" if conditions else ""
    return f"SELECT {key}, ord, code, list_filter(terms, lambda t: contains(lower({span}), t)) AS hits FROM {source}, book WHERE len(list_filter(terms, lambda t: contains(lower({span}), t))) > 0 {more}"


SQL_CONFIDENCE = "least(0.9::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * (len(hits) - 1))"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def lexical_coding(spark, sf_dir):
    return coding.coded(doc_lines(spark, sf_dir), "line", BOOK).select("doc_id", "line_no", "code", "n_hits", "confidence", "evidence")


def coding_counts(spark, sf_dir):
    found = coding.coded(doc_lines(spark, sf_dir), "line", BOOK)
    return found.groupBy("code").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_nodes"), F.max("confidence").alias("max_conf"))


def axis_rollup(spark, sf_dir):
    return coding.axis_rows(coding.coded(doc_lines(spark, sf_dir), "line", BOOK), ["doc_id", "line_no"], BOOK)


def paragraph_drilldown(spark, sf_dir):
    clauses = table(spark, sf_dir, "documents").select("doc_id", "text")
    paragraphs = doc_lines(spark, sf_dir).withColumnRenamed("line", "text")
    return coding.drill_down(clauses, paragraphs, ["doc_id"], ["line_no"], "text", BOOK)


def nodes(spark, sf_dir):
    """Lines as nodes: the first line of a document is its preamble, lines with a license word are consolidated."""
    rows = lines.lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", F.concat(F.lit("n"), F.col("line_no")).alias("node_id"), F.when(F.col("line_no") == 1, "preamble").otherwise("clause").alias("type"), F.left("line", F.lit(40)).alias("label"), "char_start", "char_end", F.when(F.contains(F.lower("line"), F.lit("license")), "consolidated").otherwise("new").alias("origin"), F.lit(True).alias("leaf"), F.col("line_no").alias("ord"), "line")


def structural_spans(spark, sf_dir):
    return coding.structural_rows(nodes(spark, sf_dir))


def predictions(spark, sf_dir):
    """Two predictions per document: low quality where a line has marks after words, toxic where a line has an insult."""
    rows = doc_lines(spark, sf_dir)
    low = rows.filter(F.col("line").rlike("[a-z](###|&&&|%%%|!!)")).select("doc_id", F.lit("low").alias("code"), F.col("line").alias("text"))
    toxic = rows.filter(F.lower("line").rlike("idiot|moron|loser|stupid|scum")).select("doc_id", F.lit("toxic").alias("code"), F.col("line").alias("text"))
    return low.unionByName(toxic)


def gold(spark, sf_dir):
    """The labels as a reference sample; the segment is the document's whole text."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return labels.filter("quality = 0").select("doc_id", F.lit("low").alias("code"), F.col("text").alias("segment")).unionByName(labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("code"), F.col("text").alias("segment")))


def harness_metrics(spark, sf_dir):
    return evaluation.scores(evaluation.pair_states(predictions(spark, sf_dir), gold(spark, sf_dir)))


def harness_global(spark, sf_dir):
    return evaluation.scores(evaluation.pair_states(predictions(spark, sf_dir), gold(spark, sf_dir)), by_code=False)


def triage_bands(spark, sf_dir):
    fit = coding.calibrated(harness_metrics(spark, sf_dir))
    notes = predictions(spark, sf_dir).select("doc_id", "code").withColumn("origin", F.lit("new")).withColumn("clause_id", F.lit("c"))
    return coding.triage(notes, fit).groupBy("code", "band").agg(F.count("*").alias("n"))


def _lowered(c):
    """As the query's SQL has it: letter by letter lower case, runs of ASCII white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(F.col(c), "İΣ", "iσ")), r"[\s\x0B]+", " "), r"^ | \z", "")


def segment_overlap(spark, sf_dir):
    """Benchmark items and document lines that overlap: either holds the other, or the longer one holds the head of the shorter."""
    items = table(spark, sf_dir, "benchmark").select("item_id", _lowered("text").alias("seg"))
    rows = doc_lines(spark, sf_dir).select("doc_id", "line_no", _lowered("line").alias("body"))
    return evaluation.overlapping(items, "item_id", "seg", rows, ["doc_id", "line_no"], "body")


def uncovered_clauses(spark, sf_dir):
    found = nodes(spark, sf_dir)
    notes = coding.coded(found, "line", BOOK).select("doc_id", "node_id")
    return coding.uncovered(found, notes).groupBy("doc_id").agg(F.count("*").alias("n_uncovered"), F.sum(F.length("line")).alias("n_chars"))


def size_batches(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return coding.size_batches(talk, ["conv_id"], "turn", "text", 400).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def reply_parsing(spark, sf_dir):
    """Event properties as the replies of a model: the number becomes a suggestion's confidence."""
    value = F.get_json_object("props", "$.k").cast("int")
    reply = F.format_string('Answer: [{"idx": "%d", "label": "x", "code": "%s", "confidence": "%s", "evidence": "%s"}] end', F.col("event_id"), F.when(value % 2 == 0, "1.1").otherwise("9.9"), F.concat(F.lit("0."), F.lpad(value.cast("string"), 2, "0")), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return coding.reply_items(rows, "reply", tuple(c.code for c in BOOK.codes)).select("event_id", "idx", "code", "confidence", "evidence")


def code_paths(spark, sf_dir):
    from ..functions.text import code_path

    found = coding.coded(doc_lines(spark, sf_dir), "line", BOOK).select(F.concat(F.lit("REVIEW/4.0"), F.col("code"), F.lit("."), F.col("n_hits")).alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("n")).select("code", F.array_join(code_path("code"), " > ").alias("path"), "n")


QUERIES = {f.__name__: f for f in (lexical_coding, coding_counts, axis_rollup, paragraph_drilldown, structural_spans, harness_metrics, harness_global, triage_bands, segment_overlap, uncovered_clauses, size_batches, reply_parsing, code_paths)}

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM documents)"
_CODED = f"WITH {SQL_BOOK}, {_LINES}, c AS ({sql_coded('l', 'doc_id, line_no', 'line')})"
_AXES = "(VALUES " + ", ".join(f"('{a}')" for a in BOOK.axes) + ") a(axis)"
_PAIRS = f"""WITH {_LINES}, p AS (
  SELECT doc_id, 'low' AS code, line AS text FROM l WHERE regexp_matches(line, '[a-z](###|&&&|%%%|!!)')
  UNION ALL SELECT doc_id, 'toxic', line FROM l WHERE regexp_matches(lower(line), 'idiot|moron|loser|stupid|scum')
), g AS (
  SELECT doc_id, 'low' AS code, text FROM labels JOIN documents USING (doc_id) WHERE quality = 0
  UNION ALL SELECT doc_id, 'toxic', text FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
), s AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.code, b.code) AS code, a.doc_id IS NOT NULL AS in_p, b.doc_id IS NOT NULL AS in_g
  FROM (SELECT DISTINCT doc_id, code FROM p) a FULL JOIN (SELECT DISTINCT doc_id, code FROM g) b ON a.doc_id = b.doc_id AND a.code = b.code
), m AS (
  SELECT code, count(*) FILTER (WHERE in_p AND in_g) AS tp, count(*) FILTER (WHERE in_p AND NOT in_g) AS fp, count(*) FILTER (WHERE in_g AND NOT in_p) AS fn, count(*) FILTER (WHERE in_g) AS n_reference FROM s GROUP BY code
), r AS (
  SELECT *, tp AS tp_segment, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM m
)"""

ORACLE_SQL = {
    "lexical_coding": f"{_CODED} SELECT doc_id, line_no, code, CAST(len(hits) AS INTEGER) AS n_hits, {SQL_CONFIDENCE} AS confidence, hits[1] AS evidence FROM c",
    "coding_counts": f"{_CODED} SELECT code, count(DISTINCT doc_id) AS n_docs, count(*) AS n_nodes, max({SQL_CONFIDENCE}) AS max_conf FROM c GROUP BY code",
    "axis_rollup": f"{_CODED} SELECT doc_id, line_no, axis, arg_min({SQL_CONFIDENCE}, ord) AS confidence, arg_min(hits[1], ord) AS evidence FROM c, {_AXES} WHERE starts_with(code, axis || '.') GROUP BY ALL",
    "paragraph_drilldown": f"""WITH {SQL_BOOK}, {_LINES}, d AS ({sql_coded('documents', 'doc_id', 'text')}), p AS ({sql_coded('l', 'doc_id, line_no', 'line', False)})
SELECT d.doc_id, p.line_no, d.code, least(0.9::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * (len(d.hits) - 1)) AS confidence, CASE WHEN p.line_no IS NULL THEN 'clause' ELSE 'paragraph' END AS level, coalesce(p.hits[1], d.hits[1]) AS evidence
FROM d LEFT JOIN p ON d.doc_id = p.doc_id AND d.code = p.code""",
    "structural_spans": f"""WITH {SQL_LINES}, n AS (SELECT *, contains(lower(line), 'license') AS cons FROM placed)
SELECT doc_id, 'n' || line_no AS node_id, char_start, char_end, 'Structure/Preamble' AS code, 1.0::DOUBLE AS confidence FROM n WHERE line_no = 1
UNION ALL SELECT doc_id, arg_min('n' || line_no, line_no), min(char_start), max(char_end), 'Structure/Consolidated', 1.0::DOUBLE FROM n WHERE cons GROUP BY doc_id""",
    "harness_metrics": f"""{_PAIRS} SELECT code, tp, fp, fn, tp_segment, n_reference, "precision", recall, CASE WHEN "precision" > 0 AND recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0::DOUBLE END AS f1 FROM r""",
    "harness_global": f"""{_PAIRS} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp_segment, sum(tp)::DOUBLE / (sum(tp) + sum(fp)) AS "precision", sum(tp)::DOUBLE / (sum(tp) + sum(fn)) AS recall FROM r""",
    "triage_bands": f"""{_PAIRS} SELECT p.code, CASE WHEN r."precision" >= 0.85 AND r.n_reference >= 2 THEN 'AUTO' ELSE 'REVIEW' END AS band, count(*) AS n FROM p LEFT JOIN r USING (code) GROUP BY ALL""",
    "segment_overlap": f"""WITH {_LINES}, b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(lower(line), '[\\s\\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS body FROM l),
i AS (SELECT item_id, regexp_replace(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS seg FROM benchmark)
SELECT DISTINCT item_id, doc_id, line_no FROM i JOIN b ON seg <> '' AND body <> '' AND (contains(body, seg) OR contains(seg, body) OR CASE WHEN length(seg) <= length(body) THEN contains(body, left(seg, greatest(40, length(seg) // 3)::INTEGER)) ELSE contains(seg, left(body, greatest(40, length(body) // 3)::INTEGER)) END)""",
    "uncovered_clauses": f"{_CODED} SELECT l.doc_id, count(*) AS n_uncovered, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l WHERE line_no > 1 AND NOT contains(lower(line), 'license') AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.line_no = l.line_no) GROUP BY l.doc_id",
    "size_batches": """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, k, n AS size, 1 AS batch, n FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, CASE WHEN f.size + t.n > 400 THEN t.n ELSE f.size + t.n END, CASE WHEN f.size + t.n > 400 THEN f.batch + 1 ELSE f.batch END, t.n FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_chars FROM f GROUP BY conv_id, batch""",
    "reply_parsing": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS v FROM events)
SELECT event_id, CAST(event_id AS INTEGER) AS idx, '1.1' AS code, CAST('0.' || lpad(CAST(v AS VARCHAR), 2, '0') AS DOUBLE) AS confidence, event_type AS evidence FROM e WHERE v % 2 = 0 AND CAST('0.' || lpad(CAST(v AS VARCHAR), 2, '0') AS DOUBLE) BETWEEN 0.5 AND 1.0""",
    "code_paths": f"""{_CODED} SELECT 'REVIEW/4.0' || code || '.' || len(hits) AS code, 'REVIEW > 4.0' || string_split(code, '.')[1] || ' > 4.0' || code || ' > 4.0' || code || '.' || len(hits) AS path, count(*) AS n FROM c GROUP BY code, len(hits)""",
}
