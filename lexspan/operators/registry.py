"""Registry of acquired documents: derived fields, upserts, states, ordinals, references, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import acronym, bind, col, messy_int, strip_accents, type_key

#: Document families by prefix of the type, the first that fits. Fixed values, in order of precedence.
FAMILY_PREFIXES = [
    ("CCT", "agreement"), ("ACTV", "agreement"), ("ACEP", "agreement"), ("ACT", "agreement"), ("AE", "agreement"), ("DA", "agreement"),
    ("PE", "extension"), ("PCT", "extension"), ("PRT", "extension"), ("AVISO", "notice"), ("AV", "notice"), ("AA", "accession"),
]
#: Words left out of an acronym made from a name. Fixed values.
LINK_WORDS = "de do da dos das e em a o as os no na nos nas para com ao aos à às".split()
LEGAL_FORMS = "sa s lda ldª l da unipessoal crl sarl sgps inc sucursal limitada sociedade em ea eim ldas".split()
GENERIC_WORDS = "sindicato sindicatos sindical sindicais associacao associacoes federacao confederacao uniao nacional nacionais trabalhadores trabalhadoras profissionais portugues portuguesa portugueses portugal".split()
DOWNLOADED = ("descarregado", "ja_existente", "inalterado")
LONGEST_NAME = 63


def family(kind, prefixes: list[tuple[str, str]] = FAMILY_PREFIXES) -> Column:
    """The family of a document type: the first prefix that fits, null if none does."""
    plain = F.regexp_replace(F.upper(strip_accents(kind)), "[^A-Z0-9]", "")
    return bind(plain, lambda p: F.coalesce(*[F.when(F.startswith(p, F.lit(prefix)), name) for prefix, name in prefixes]))


def path_part(url, place: int) -> Column:
    """A segment of the URL's path, counted from 1, or from -1 at the end; null if there are fewer."""
    parts = F.filter(F.split(F.parse_url(col(url), F.lit("PATH")), "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(place))


def safe_name(file) -> Column:
    """The last component of a path; null for names that aren't files."""
    last = F.element_at(F.split(col(file), "/"), -1)
    return F.when(~last.isin("", ".", ".."), last)


def complete(items: DataFrame) -> DataFrame:
    """Derive year, issue, file, url and key of index rows (year, issue_no, file, url, id, title as text).

    Year and issue come from the cell, else from the URL's third and second last segments; the file from the cell, else from the URL. The key is
    year/issue/stem, with the id or the title's start where there is no file.
    """
    file = F.coalesce(safe_name(F.nullif(F.trim("file"), F.lit(""))), safe_name(path_part("url", -1)))
    year, issue = F.coalesce(messy_int("year"), messy_int(path_part("url", -3))), F.coalesce(messy_int("issue_no"), messy_int(path_part("url", -2)))
    out = items.withColumn("file", file).withColumn("year", year).withColumn("issue_no", issue)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    plain = lambda c: F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{Nd}]", "")
    base = F.coalesce(F.nullif(stem, F.lit("")), F.nullif(plain("id"), F.lit("")), F.left(plain("title"), F.lit(40)))
    return out.withColumn("key", F.concat_ws("/", F.coalesce(F.col("year").cast("string"), F.lit("None")), F.coalesce(F.col("issue_no").cast("string"), F.lit("None")), base))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key. Pre-aggregated: no key is gathered."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__x")).select(*key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New values replace old ones unless they are null or empty; keys of either side stay."""
    fields = [c for c in old.columns if c not in key]
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    value = lambda c: F.coalesce(F.when(F.col(f"b.{c}").cast("string") != "", F.col(f"b.{c}")), F.col(f"a.{c}")).alias(c)
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[value(c) for c in fields])


def fold_values(rows: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """A run of upserts at once: each field's last value that isn't null or empty."""
    return rows.groupBy(*key).agg(*[F.max_by(F.col(f), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.col(order))).alias(f) for f in fields])


def download_state(in_scope: Column, url: Column, same_hash: Column, online: Column, status: Column, is_pdf: Column) -> Column:
    """The state of an item: ignored, failed (no URL), already there, still to download, unchanged, downloaded, failed."""
    return (
        F.when(~in_scope, "ignorado").when(F.coalesce(url, F.lit("")) == "", "falhado").when(same_hash, "ja_existente").when(~online, "por_descarregar")
        .when(status == 304, "inalterado").when((status == 200) & is_pdf, "descarregado").otherwise("falhado")
    )


def ordinals(rows: DataFrame, part: list[str], assigned: str, order: list[str]) -> DataFrame:
    """Append ``ordinal``: assigned numbers stay, the others follow from the highest, in order, missing values as 0.

    Only rows without a number are ordered; the highest number is one pre-aggregated row per part.
    """
    top = rows.groupBy(*part).agg(F.coalesce(F.max(assigned), F.lit(0)).alias("__top"))
    have = rows.filter(F.col(assigned).isNotNull()).withColumn("ordinal", F.col(assigned).cast("long"))
    by = [F.coalesce(F.col(c), F.lit(0)) if rows.schema[c].dataType.simpleString() in ("int", "bigint") else F.col(c) for c in order]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(*by))
    new = rows.filter(F.col(assigned).isNull()).join(top, part).withColumn("ordinal", (F.col("__top") + rank).cast("long")).drop("__top")
    return have.unionByName(new)


def earlier_names(rows: DataFrame, key: list[str], order: list[str], name: str, whole: bool = False) -> DataFrame:
    """Append (previous, n_earlier): of the rows of the key before this one the last one's name, and how many there are.

    With ``whole`` all their names are gathered too, as ``earlier``, joined by ``; ``: that grows with the square of a key's rows and is for keys known to be small.
    """
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("previous", F.lag(name).over(Window.partitionBy(*key).orderBy(*order))).withColumn("n_earlier", F.count(F.lit(1)).over(before))
    return out.withColumn("earlier", F.array_join(F.collect_list(name).over(before), "; ")) if whole else out


def chain_refs(chain) -> Column:
    """References of an alteration chain: array of (kind, date, number, year) for parts such as KIND.yyyymmdd.nnn/yyyy."""
    parts = F.filter(F.split(col(chain), "[;\n]"), lambda p: F.trim(p) != "")
    shape = r"^\s*([A-Z][A-Z-]*)\.(\d{8})\.(\d+)/(\d{4})\s*$"
    return F.transform(F.filter(parts, lambda p: p.rlike(shape)), lambda p: F.struct(F.regexp_extract(p, shape, 1).alias("kind"), F.regexp_extract(p, shape, 2).alias("date"), F.regexp_extract(p, shape, 3).cast("int").alias("number"), F.regexp_extract(p, shape, 4).alias("year")))


def resolve_base(entries: DataFrame) -> DataFrame:
    """Append (base_codes, unresolved) to entries other than agreements: codes of the agreements that their chain names.

    ``entries`` has (key, family, type, id as nnn/yyyy, code, chain). A reference counts only if exactly one agreement has its number, year and
    type. Codes keep the chain's order, the first of repeated ones.
    """
    shape = r"^\s*(\d+)\s*/\s*(\d{4})\s*$"
    base = entries.filter("family = 'agreement'").select(F.regexp_extract("id", shape, 1).cast("int").alias("number"), F.regexp_extract("id", shape, 2).alias("year"), type_key("type").alias("kind"), "code").filter("number is not null")
    only = base.groupBy("number", "year", "kind").agg(F.count("*").alias("n"), F.min("code").alias("code")).filter("n = 1").drop("n")
    refs = entries.filter("family <> 'agreement'").select("key", F.posexplode(chain_refs("chain")).alias("at", "r")).select("key", "at", "r.kind", "r.number", "r.year")
    found = refs.join(only, ["number", "year", "kind"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("x"))
    codes = F.array_distinct(F.filter(F.transform("x", lambda r: r["code"]), lambda c: c.isNotNull()))
    return entries.join(found.select("key", F.array_join(codes, "; ").alias("base_codes"), F.size(F.filter("x", lambda r: r["code"].isNull())).alias("unresolved")), "key", "left")


def camel(name, longest: int = 20) -> Column:
    """A short form of a name: its first four telling words in camel case, whole words only, ``SemNome`` if nothing is left."""
    parts = F.filter(F.split(strip_accents(name), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 2)
    useful = F.filter(parts, lambda w: ~F.lower(w).isin(*LINK_WORDS, *LEGAL_FORMS))
    shaped = F.transform(useful, lambda w: F.when(w == F.upper(w), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    telling = F.filter(shaped, lambda w: ~F.lower(w).isin(*GENERIC_WORDS))
    chosen = F.slice(F.when(F.size(telling) > 0, telling).otherwise(shaped), 1, 4)
    # words are added while they fit; the first that doesn't ends the name
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))
    built = F.aggregate(chosen, start, lambda a, w: F.when(a["full"] | ((a["s"] != "") & (F.length(a["s"]) + F.length(w) > longest)), F.struct(a["s"].alias("s"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["s"], w).alias("s"), F.lit(False).alias("full"))))
    return F.coalesce(F.nullif(F.left(built["s"], F.lit(longest)), F.lit("")), F.lit("SemNome"))


def guessed_acronym(name) -> Column:
    """The acronym that a name itself gives: in brackets, after a final dash, before a first dash, between dashes; null if none does."""
    fits = lambda t: F.when((F.length(acronym(t, 30)).between(2, 20)) & (acronym(t, 30) == F.upper(acronym(t, 30))) & acronym(t, 30).rlike("[A-Z]"), acronym(t, 30))
    found = F.concat(*[F.regexp_extract_all(col(name), F.lit(p), F.lit(1)) for p in (r"\(([^)]{2,30})\)", r"[-–—]\s*([^-–—,;()]{2,30})\s*$", r"^\s*([^-–—,;()]{2,30}?)\s*[-–—]\s", r"[-–—]\s*([^-–—,;()]{2,30}?)\s*(?=[-–—]|$)")])
    return F.try_element_at(F.filter(F.transform(found, fits), lambda x: x.isNotNull()), F.lit(1))


def is_union(name) -> Column:
    return F.contains(F.lower(strip_accents(name)), F.lit("sindic"))


def parties(signatories, title=None) -> Column:
    """Signatories as an array: split at ; or line breaks, else the two sides that the title names."""
    split = F.filter(F.transform(F.split(col(signatories), "[;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    if title is None:
        return split
    flat = F.regexp_replace(col(title), r"\s+", " ")
    shape = r"(?i)\bentre\s+(?:as|os|a|o)?\s*(.+?)\s+e\s+(?:as|os|a|o)\s+(.+?)\s*$"
    side = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_extract(flat, shape, k), r"(?i)\s+e\s+outr[ao]s?\s*$", ""), r"^[ .,;]+|[ .,;]+$", "")
    return F.when(F.size(split) > 0, split).otherwise(F.filter(F.array(side(1), side(2)), lambda p: p != ""))


def chosen_parties(names: Column) -> Column:
    """The first employer and the first union; with one side only, its first two."""
    employers, unions = F.filter(names, lambda n: ~is_union(n)), F.filter(names, is_union)
    return F.when((F.size(employers) > 0) & (F.size(unions) > 0), F.array(F.element_at(employers, 1), F.element_at(unions, 1))).otherwise(F.slice(names, 1, 2))


def order_reference(text, issue_year: Column) -> Column:
    """(number, suffix, year) of a government order cited in a text; null for number 0 or a year after the issue's."""
    shape = r"(?i)\bPortaria\s+n\.?\s*[º°o]?\s*(\d{1,4})(?:\s*-\s*([A-Za-z]))?\s*/\s*(\d{4})\b"
    number, year = F.regexp_extract(col(text), shape, 1), F.regexp_extract(col(text), shape, 3)
    good = (number != "") & (number.cast("int") > 0) & (year.cast("int") <= issue_year)
    return F.when(good, F.struct(number.cast("int").alias("number"), F.upper(F.regexp_extract(col(text), shape, 2)).alias("suffix"), year.cast("int").alias("year")))


def compose_name(prefix: Column, acronyms: Column, rest: Column, join: str = "-", longest: int = LONGEST_NAME) -> Column:
    """prefix + acronyms + (+rest): acronyms are shortened evenly so that the name fits; null if fewer than 3 characters each would stay."""
    tail = F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"))).otherwise("")
    whole = F.concat(prefix, F.array_join(acronyms, join), tail)
    room = F.lit(longest) - F.length(prefix) - F.length(tail) - (F.size(acronyms) - 1)
    each = F.floor(room / F.size(acronyms)).cast("int")
    cut = F.concat(prefix, F.array_join(F.transform(acronyms, lambda a: F.left(a, each)), join), tail)
    return F.when(F.length(whole) <= longest, whole).when(room >= 3 * F.size(acronyms), cut)


def short_prefix(year: Column, kind: Column, ordinal: Column, issue: Column) -> Column:
    """The head of a name in the short scheme: year in two digits, the family's token, ordinal and issue."""
    token = F.when(kind == "extension", "PE").when(kind == "notice", "AV").when(kind == "accession", "AA").otherwise("PR")
    return F.concat_ws("_", F.lpad((F.coalesce(year, F.lit(0)) % 100).cast("string"), 2, "0"), token, F.format_string("%03d", ordinal), F.lit("BTE"), F.format_string("%02d", F.coalesce(issue, F.lit(0))))


def short_name(prefix: Column, acronyms: Column, longest: int = LONGEST_NAME) -> Column:
    """A name in the short scheme: the head and the sides' acronyms, which are cut evenly, to 4 characters at least, where the name is too long."""
    whole = F.concat(prefix, F.array_join(F.transform(acronyms, lambda a: F.concat(F.lit("_"), a)), ""))
    each = F.greatest(F.lit(4), F.floor((F.lit(longest) - F.length(prefix) - F.size(acronyms)) / F.size(acronyms)).cast("int"))
    return F.when(F.length(whole) <= longest, whole).otherwise(F.concat(prefix, F.array_join(F.transform(acronyms, lambda a: F.concat(F.lit("_"), F.left(a, each))), "")))


def long_prefix(year: Column, issue: Column, kind: Column, scope_: Column, doc_type: Column, number: Column, order: Column, code: Column) -> Column:
    """The head of a name in the long scheme: agreements by scope, number, type and code; extensions by type, number, order and base code; accessions and
    notices by type, number and base code. Null where a part that the scheme needs is missing: a known type, the order of an extension, the base code."""
    head = F.concat(F.format_string("%04d", F.coalesce(year, F.lit(0))), F.lit("_BTE_"), F.format_string("%02d", F.coalesce(issue, F.lit(0))), F.lit("_"))
    seq = F.format_string("_%03d", number)
    ref = F.concat(F.format_string("_%04d", order["number"]), order["suffix"], F.format_string("-%04d", order["year"]))
    code = F.nullif(code, F.lit(""))
    own = F.concat(head, scope_, seq, F.lit("_"), doc_type, F.lit("_"), F.coalesce(code, F.lit("0")), F.lit("_"))
    other = lambda middle, code: F.concat(head, doc_type, seq, middle, F.lit("_"), code, F.lit("_"))
    return (
        F.when(kind == "extension", F.when(doc_type.isin("PE", "PCT", "PRT"), other(ref, code))).when(kind == "accession", F.when(doc_type == "AA", other(F.lit(""), code)))
        .when(kind == "notice", F.when(doc_type.isin("AVISO", "AV"), other(F.lit(""), F.coalesce(code, F.lit("0"))))).otherwise(own)
    )


#: Acronyms of the register that tell nobody apart. Fixed values.
REFUSED_ACRONYMS = "IN PT SUL NORTE CGTP UGT SA LDA".split()


def base_acronym(name, given) -> tuple[Column, Column]:
    """(acronym, source): the register's, unless it is refused or has no 2 to 20 characters; else the one that the name gives; else its short form."""
    clean, derived = acronym(given, 20), guessed_acronym(name)
    own = F.coalesce(~F.upper(clean).isin(*REFUSED_ACRONYMS) & (F.length(clean) >= 2), F.lit(False))
    told = F.coalesce(~F.upper(derived).isin(*REFUSED_ACRONYMS), F.lit(False))
    return F.when(own, clean).when(told, derived).otherwise(camel(name)), F.when(own, "registry").when(told, "derived").otherwise("fallback")


def scope(employer, kind, public: str, state: str) -> Column:
    """Scope of an agreement: APU by type or name, SPE by name, else PRI. The patterns are the caller's vocabulary."""
    plain = F.lower(strip_accents(employer))
    return F.when(F.startswith(type_key(kind), F.lit("ACEP")) | plain.rlike(public), "APU").when(plain.rlike(state), "SPE").otherwise("PRI")


def naming_state(family_ok: Column, has_source: Column, warned: Column, confirmed: Column, target_exists: Column, same_content: Column, renamed: Column, migrate: Column) -> Column:
    """The state of naming a document, by precedence: no source, to confirm, already there, conflict, to migrate, named."""
    return (
        F.when(~family_ok, "ignorado").when(~has_source, "sem_origem").when(warned & ~confirmed, "por_confirmar").when(target_exists & same_content, "ja_existente")
        .when(target_exists, "conflito").when(renamed & ~migrate, "por_migrar").otherwise("nomeado")
    )


def pending(rows: DataFrame) -> DataFrame:
    """Rows that wait for a person, by key."""
    return rows.filter("state = 'por_confirmar'").orderBy("key")


def decisions(answers: DataFrame) -> DataFrame:
    """Acronyms confirmed by people: (entity, acronym, error). An empty acronym, or two for one entity, is an error for that entity."""
    clean = answers.select("entity", acronym("answer").alias("acronym"))
    out = clean.groupBy("entity").agg(F.count_distinct("acronym").alias("__n"), F.min("acronym").alias("acronym"))
    return out.select("entity", "acronym", F.when(F.col("acronym") == "", "empty").when(F.col("__n") > 1, "contradiction").alias("error"))


def union_by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """Vocabulary tables (key, value, line_no) as one: earlier tables win, within a table the first line."""
    every = None
    for k, t in enumerate(tables):
        t = t.withColumn("__prio", F.lit(k))
        every = t if every is None else every.unionByName(t)
    return every.groupBy(key).agg(F.min_by("value", F.struct("__prio", "line_no")).alias("value"))
