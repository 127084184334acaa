"""Quality rules: a decision list learned by sequential covering. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: What rules may test: name, and its expression over the counts of statistics().
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks", "n_capitals", "n_digits"]
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def statistics(docs: DataFrame, carry: list[str], text: str = "text", window: int = 5) -> DataFrame:
    """Append COUNTS (long) of the whole text to every row; a null text counts as empty.

    ``n_repeat_words`` is the number of words in windows of five words that are found twice or more in the text, the
    first included. Windows are compared by 64-bit hashes. Their number of distinct ones is found with a hash set; only a text
    that repeats one has its windows sorted, so a text of n words costs n log n at most and nothing leaves its row.
    Input columns named like the counts are replaced. The counts are written once: a filter on them, pushed into these
    expressions, would evaluate them again for each element.
    """

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("__t", pattern, "")).cast("long")

    held = [F.col(f"`{c}`") for c in carry if c not in COUNTS]
    steps = docs.select(*held, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    steps = steps.withColumn("__w", F.filter(F.split("__t", SPACE, -1), lambda w: w != ""))
    steps = steps.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    steps = steps.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    count = F.size("__w") - (window - 1)
    gram = lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(window)])
    steps = steps.withColumn("__g", F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), gram)).otherwise(F.expr("cast(array() as array<bigint>)")))
    placed = F.transform("__g", lambda g, i: F.struct(g.alias("h"), i.alias("i")))
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    steps = steps.withColumn("__p", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(placed)).otherwise(none))
    twin = lambda x, k: F.coalesce(F.get("__p", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__p", k + 1)["h"] == x["h"], F.lit(False))
    steps = steps.withColumn("__s", F.sort_array(F.transform(F.filter("__p", twin), lambda x: x["i"])))
    spans = F.transform("__s", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("__s", k + 1) - p, F.lit(window))))
    add = lambda a, x: a + x
    made = {
        "n_words": F.size("__w"),
        "word_chars": F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": left("[^#*$%&|<>]+"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.aggregate(spans, F.lit(0), add),
        "n_lines": F.size("__l"),
        "n_distinct": F.size(F.array_distinct("__h")),
        "n_marks": left("[^!-/:-@\\[-`{-~]+"),
        "n_capitals": left("[^A-Z]+"),
        "n_digits": left("[^0-9]+"),
    }
    return materialize(steps.select(*held, *[made[c].cast("long").alias(c) for c in COUNTS]))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


def decision_list(rules: list[Rule]) -> Column:
    """The ordered rules as one conditional expression over the counts: true keeps a row, the first rule that holds drops it."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(rule.sql()), F.lit(False)).otherwise(out)
    return out


def learn(counted: DataFrame, labels: DataFrame, label: str = "quality", places: int = 32, most_rules: int | None = None, most_conditions: int = 3, precision: float = 0.9, support: int = 5) -> list[Rule]:
    """Rules for label 0, learned by sequential covering from ``counted`` (doc_id and COUNTS) and all of ``labels``.

    Two thirds of the labelled rows, by hash of doc_id, grow a rule: the condition with the largest information gain is added until only
    label 0 is covered or ``most_conditions`` are used. The other third prunes it: conditions fall off the end while
    (p - n) / (p + n) doesn't fall. A rule that doesn't keep ``precision`` is dropped, and the next begins with another feature. One that keeps ``precision`` on at least ``support`` rows of either part is emitted, what it covers is taken
    away, and the next is grown, until none is found (or there are ``most_rules``). Rows that fail the base rule aren't used, for the list isn't asked about them.

    Every step is one aggregation of binned features over all labelled rows; the driver sees at most
    places * features * 4 counts. Rows with null or contradicting labels are left out; without usable labels the list is empty.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top").select("doc_id", "y")
    known = counted.filter(f"not ({BASE_FAILED})").join(one, "doc_id").select("doc_id", "y", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    known = materialize(known.withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 2))
    # thresholds: quantiles of either class, so that a rare kind of row has places of its own
    shares = [k / places for k in range(places + 1)]
    cuts = known.groupBy("y").agg(*[F.percentile_approx(f, shares, 5000).alias(f) for f in FEATURES]).collect()
    edges = {f: sorted({x for row in cuts for x in row[f]}) for f in FEATURES}
    if len(cuts) < 2:
        return []
    def place(f: str) -> Column:  # how many thresholds the row reaches
        return F.aggregate(F.array(*map(F.lit, edges[f])), F.lit(0), lambda a, e: a + (F.col(f) >= e).cast("int"))

    binned = known.select("y", "grow", *[place(f).alias(f) for f in FEATURES])
    binned = materialize(binned)

    def holds(c: Condition) -> Column:
        place = F.lit(edges[c.feature].index(c.threshold) + 1)
        return F.col(c.feature) >= place if c.at_least else F.col(c.feature) < place

    def counts(rows: DataFrame) -> dict[tuple[bool, str], dict[int, list[int]]]:
        """For each part and feature: place -> [rows with label 0, others]."""
        cells = rows.select("y", "grow", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("place")) for f in FEATURES])).alias("c"))
        out: dict = {}
        for r in cells.groupBy("grow", "c.f", "c.place").agg(F.count_if(F.col("y") == 0).alias("p"), F.count_if(F.col("y") != 0).alias("n")).collect():
            out.setdefault((r["grow"], r["f"]), {})[r["place"]] = [r["p"], r["n"]]
        return out

    def total(found: dict, grow: bool) -> tuple[int, int]:
        cells = found.get((grow, "words"), {}).values()
        return sum(p for p, _ in cells), sum(n for _, n in cells)

    def gain(p: int, n: int, p0: int, n0: int) -> float:
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0

    rules: list[Rule] = []
    left, refused = binned, set()
    while (most_rules is None or len(rules) < most_rules) and len(refused) < len(FEATURES):
        conditions: list[Condition] = []
        rows, found = left, counts(left)
        trail = [total(found, False)]  # on the pruning part, after each condition
        while len(conditions) < most_conditions:
            p0, n0 = total(found, True)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in FEATURES if conditions else [f for f in FEATURES if f not in refused]:
                cells = found.get((True, f), {})
                for k, edge in enumerate(edges[f]):
                    above = [sum(x[i] for place, x in cells.items() if place > k) for i in (0, 1)]
                    for at_least, (p, n) in ((True, above), (False, (p0 - above[0], n0 - above[1]))):
                        if p >= support and (g := gain(p, n, p0, n0)) > best[0]:
                            best = (g, Condition(f, at_least, edge))
            if best[1] is None:
                break
            conditions.append(best[1])
            rows = rows.filter(holds(best[1]))
            found = counts(rows)
            trail.append(total(found, False))
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in trail]
        keep = len(conditions)
        while keep > 1 and worth[keep - 1] >= worth[keep]:
            keep -= 1
        conditions = conditions[:keep]
        if not conditions:
            break
        covers = conditions[0] and holds(conditions[0])
        for c in conditions[1:]:
            covers = covers & holds(c)
        tally = left.filter(covers).agg(F.count_if(F.expr("grow and y = 0")), F.count_if(F.expr("grow and y <> 0")), F.count_if(F.expr("not grow and y = 0")), F.count_if(F.expr("not grow and y <> 0"))).first()
        if tally[0] + tally[1] < support or tally[0] < precision * (tally[0] + tally[1]) or tally[2] < precision * (tally[2] + tally[3]):
            refused.add(conditions[0].feature)  # another beginning may do better
            continue
        refused.clear()
        rules.append(Rule(tuple(conditions), sum(tally), (tally[0] + tally[2]) / sum(tally)))
        left = left.filter(~covers)
    return rules


def judge(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Append ``base_failed`` and ``kept`` to rows with COUNTS: too short or too repetitive texts go, then those that a rule drops."""
    return counted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(decision_list(rules)))
