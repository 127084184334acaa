"""The catalogue: derived columns, notices tied to orders, and the merge that never loses a person's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, type_key

IDENTITY = ("year", "yearly_no", "issue_no", "type", "file", "url", "title")
TEAM = ("state_team", "theme", "notes", "responsible", "date_team")
AUTOMATIC_STATES = ("", "recolhido", "nao_processavel", "por_confirmar", "metadado")
ORPHAN, REPEATED = "no longer in the indexes", "repeated document: team columns not restored"


def split_sectors(raw, candidates: list[str]) -> tuple[Column, Column]:
    """(subjects, candidates) of a ; list: parts that hold one of the given terms are candidates; distinct, in order."""
    parts = F.array_distinct(F.filter(F.transform(F.split(col(raw), ";"), lambda p: F.trim(p)), lambda p: p != ""))
    hit = lambda p: F.exists(F.array(*map(F.lit, candidates)), lambda t: F.contains(F.lower(p), t))
    return F.filter(parts, lambda p: ~hit(p)), F.filter(parts, hit)


def split_chain(raw) -> tuple[Column, Column]:
    """(structured, unresolved) references of an alteration chain."""
    parts = F.filter(F.transform(F.split(col(raw), "[;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    good = lambda p: p.rlike(r"^[A-Z][A-Z-]*\.\d{8}\.\d+/\d{4}$")
    return F.filter(parts, good), F.filter(parts, lambda p: ~good(p))


def relation(family: Column, structured: Column, unresolved: Column) -> tuple[Column, Column]:
    """(verb, targets): what an extension, accession, notice or agreement does to the documents it names."""
    targets = F.array_join(F.concat(structured, unresolved), "; ")
    verb = F.when(family == "extension", "extends").when(family == "accession", "joins").when(family == "agreement", "alters").otherwise("mentions")
    return F.when(targets == "", "").otherwise(verb), targets


def page_range(stem) -> tuple[Column, Column]:
    """(first, last) from a stem of eight digits, if 0 < first <= last."""
    a, b = F.regexp_extract(col(stem), r"^(\d{4})(\d{4})$", 1).try_cast("int"), F.regexp_extract(col(stem), r"^(\d{4})(\d{4})$", 2).try_cast("int")
    good = (a > 0) & (a <= b)
    return F.when(good, a), F.when(good, b)


def negotiation_act(code, digits: tuple[str, ...]) -> Column:
    """The act of an IRCT code: of five digits without the family digit, if that is a known one, else blank; other lengths pass."""
    plain = F.regexp_replace(col(code), r"\D", "")
    return F.when(F.length(plain) != 5, plain).when(F.left(plain, F.lit(1)).isin(*digits), F.substr(plain, F.lit(2))).otherwise("")


def identity(columns: tuple[str, ...] = IDENTITY) -> Column:
    """A document's identity: its trimmed identity columns, null if all are blank."""
    parts = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.when(F.concat(*parts) != "", F.concat_ws("\x1f", *parts))


def worked_on(team: tuple[str, ...], state: str = "state") -> Column:
    """A person has filled a team column or set a state."""
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in team]
    out = ~F.coalesce(F.col(state), F.lit("")).isin(*AUTOMATIC_STATES)
    for f in filled:
        out = out | f
    return out


def merge(new: DataFrame, old: DataFrame, ident: tuple[str, ...] = IDENTITY, name: str = "name", team: tuple[str, ...] = TEAM, state: str = "state") -> DataFrame:
    """The new catalogue with the team's columns of the old one: all columns of new and ``warning`` (null, ORPHAN or REPEATED).

    Old rows that nobody worked on and whose document is in the new catalogue are copies and go first. The others match new rows by identity, then what is left by
    name. One to one: team columns, and a state set by a person, pass over. Otherwise nothing passes; the new rows are marked and the old
    ones stay, once each. Old rows without a match stay as orphans. A document that is repeated in the new catalogue is always marked.

    Counts per key decide which rows match, so every step is an equi-join on a key with one row per side, or an anti-join.
    """
    columns = new.columns
    n = new.withColumn("__id", identity(ident)).withColumn("__name", F.nullif(F.trim(name), F.lit(""))).withColumn("__n", F.monotonically_increasing_id())
    o = old.select(*columns).withColumn("__id", identity(ident)).withColumn("__name", F.nullif(F.trim(name), F.lit("")))
    per = n.filter("__id is not null").groupBy("__id").agg(F.count("*").alias("__c"))
    n = n.join(per, "__id", "left").withColumn("__twice", F.coalesce(F.col("__c") > 1, F.lit(False))).drop("__c")
    o = o.join(per.select("__id", F.lit(True).alias("__known")), "__id", "left").filter(worked_on(team, state) | F.col("__known").isNull()).drop("__known")

    def step(n: DataFrame, o: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Split by key: matched new rows (with what passes over), new rows left, old rows kept as repeated, old rows left."""
        cn, co = n.filter(f"{key} is not null").groupBy(key).agg(F.count("*").alias("__cn")), o.filter(f"{key} is not null").groupBy(key).agg(F.count("*").alias("__co"))
        both = cn.join(co, key).select(key, ((F.col("__cn") == 1) & (F.col("__co") == 1)).alias("__one"))
        touched = n.join(both, key, "left")
        give = o.select(key, F.struct(*team, state).alias("__give"))
        matched = touched.filter("__one").join(give, key).withColumn("__twice", F.col("__twice"))
        unclear = touched.filter("not __one").withColumn("__twice", F.lit(True))
        passed = matched.select(*[c for c in touched.columns if c not in (*team, state, "__one")], *[F.coalesce(F.nullif(F.col(f"__give.{c}"), F.lit("")), F.col(c)).alias(c) for c in team], F.when(~F.coalesce(F.col(f"__give.{state}"), F.lit("")).isin(*AUTOMATIC_STATES), F.col(f"__give.{state}")).otherwise(F.col(state)).alias(state))
        old = o.join(both, key, "left")
        return passed.unionByName(unclear.drop("__one")), touched.filter("__one is null").drop("__one"), old.filter("not __one").drop("__one"), old.filter("__one is null").drop("__one")

    done1, n1, twice1, o1 = step(n, o, "__id")
    done2, n2, twice2, o2 = step(n1, o1, "__name")
    warn = lambda df, w: df.select(*columns, w.alias("warning"))
    marked = F.when(F.col("__twice"), REPEATED)
    out = warn(done1, marked).unionByName(warn(done2, marked)).unionByName(warn(n2, marked))
    out = out.unionByName(warn(twice1, F.lit(REPEATED))).unionByName(warn(twice2, F.lit(REPEATED)))
    return out.unionByName(warn(o2, F.lit(ORPHAN)))


def tie_notices(orders: DataFrame, notices: DataFrame, target: str, date: str, notice_id: str) -> DataFrame:
    """Append ``notices`` to orders: ids of all notices with the same whole target, dated at or before the order (as text)."""
    from .lookup import earlier_matches

    return earlier_matches(orders, notices, [target], date, notice_id, whole=True)


#: Folders of families, and those that scopes divide. Fixed values.
FOLDERS = {"agreement": "convencoes", "extension": "portarias_extensao", "accession": "acordos_adesao"}
UNKNOWN_FOLDER, ROOT_FOLDER, KNOWN_DIGITS = "por_classificar", "1_fontes/irct", ("2", "4")


def base_columns(kind: Column, code, base_codes, order: Column) -> tuple[Column, Column, Column]:
    """(base code, further ones, government order): of an agreement its own code, of others the first of the agreements that they name, in order, and the rest."""
    own = F.regexp_replace(F.coalesce(col(code), F.lit("")), r"\D", "")
    named = F.filter(F.split(F.coalesce(col(base_codes), F.lit("")), r"[;\s]+"), lambda c: c != "")
    agreement = kind == "agreement"
    return (
        F.when(agreement, own).otherwise(F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(""))),
        F.when(agreement, "").otherwise(F.array_join(F.slice(named, 2, F.greatest(F.size(named), F.lit(1))), "; ")),
        F.when(agreement, "").otherwise(F.coalesce(order, F.lit(""))),
    )


def project(items: DataFrame, candidates: list[str], public: str, state: str) -> DataFrame:
    """The catalogue: one row of derived columns per index item, in one projection.

    ``items`` has text columns (name, warnings, type, title, signatories, sectors, chain, file, url, code, base_codes, order_ref, in_force, date) and the numbers (year, issue_no, yearly_no);
    a blank name has no file yet. The columns of people are blank; what they filled passes over in ``merge``.
    """
    from .admission import METADATA_FAMILIES, processable
    from .registry import family, is_union, parties, scope

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = items.withColumns({c: text(c) for c in ("name", "warnings", "type", "title", "signatories", "sectors", "chain", "file", "url", "code", "base_codes", "order_ref", "in_force", "date")})
    names = parties("signatories", "title")
    rows = rows.withColumns({"__employers": F.filter(names, lambda n: ~is_union(n)), "__unions": F.filter(names, is_union), "__family": F.coalesce(family("type"), F.lit(""))})
    rows = rows.withColumn("__scope", scope(F.coalesce(F.try_element_at("__employers", F.lit(1)), F.col("title")), F.col("type"), public, state))
    kind, place = F.col("__family"), F.col("__scope")
    subjects, open_sectors = split_sectors("sectors", candidates)
    good, bad = split_chain("chain")
    verb, targets = relation(kind, good, bad)
    first, last = page_range(F.regexp_replace("file", r"\.[^.]*$", ""))
    base, further, order = base_columns(kind, "code", "base_codes", F.col("order_ref"))
    can, metadata = processable(kind, place), kind.isin(*METADATA_FAMILIES)
    folder = F.coalesce(*[F.when(kind == k, f) for k, f in FOLDERS.items()], F.lit(UNKNOWN_FOLDER))
    folder = F.when(kind == "agreement", F.concat(folder, F.lit("/"), place)).otherwise(folder)
    all_names = F.concat("__employers", "__unions")
    out = {
        "name": F.col("name"), "target": F.when((F.col("name") == "") | metadata, "").otherwise(F.concat(F.lit(ROOT_FOLDER + "/"), folder, F.lit("/"), F.col("name"), F.lit(".pdf"))), "file": F.col("file"),
        "year": F.col("year"), "yearly_no": F.col("yearly_no"), "type": type_key("type"), "family": kind, "processable": F.when(can, "sim").otherwise("nao"), "scope": place, "code": F.col("code"),
        "act": negotiation_act("code", KNOWN_DIGITS), "base_code": base, "further_codes": further, "order_ref": order, "issue_no": F.col("issue_no"), "issue_date": F.left("date", F.lit(10)),
        "first_page": first, "last_page": last, "n_signatories": F.size(all_names), "signatories": F.array_join(all_names, "; "), "relation": verb, "relation_target": F.when(verb != "", F.array_join(good, "; ")).otherwise(""),
        "structured": F.array_join(good, "; "), "unresolved": F.array_join(bad, "; "), "in_force": F.col("in_force"), "subjects": F.array_join(subjects, "; "), "open_sectors": F.array_join(open_sectors, "; "),
        "url": F.col("url"), "title": F.col("title"), "state": F.when(metadata, "metadado").when(F.col("name") == "", "por_confirmar").when(can, "recolhido").otherwise("nao_processavel"), "warnings": F.col("warnings"),
        **{c: F.lit("") for c in TEAM},
    }
    return rows.select(*[v.alias(k) for k, v in out.items()])


def counts(catalogue: DataFrame) -> DataFrame:
    """(what, value, n): documents by family and scope, those that may be processed, with warnings, with open sectors and without a name, and names that several have."""
    named = catalogue.filter("name <> ''").groupBy("name").agg(F.count("*").alias("k")).filter("k > 1")
    flag = lambda what, cond: catalogue.filter(cond).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("value"), "n")
    by = lambda c, blank: catalogue.groupBy(F.coalesce(F.nullif(c, F.lit("")), F.lit(blank)).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "value", "n")
    out = by("family", UNKNOWN_FOLDER).unionByName(by("scope", "")).unionByName(named.select(F.lit("collision").alias("what"), F.col("name").alias("value"), F.col("k").alias("n")))
    for what, cond in (("processable", "processable = 'sim'"), ("warned", "warnings <> ''"), ("open sectors", "open_sectors <> ''"), ("unnamed", "name = ''")):
        out = out.unionByName(flag(what, cond))
    return out
