"""Lookup joins that aren't plain equalities: containment, prefixes, token coverage, uniqueness, chains of parents.

Keys and names meet by equi-joins on pieces of them, so neither side is broadcast by hand or crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBE = 6


def contained_keys(names: DataFrame, name: str, keys: DataFrame, least: int) -> DataFrame:
    """Rows of names with (key, value, ord) of every key of at least ``least`` characters that lies in the name.

    ``keys`` has (key, value, ord). Names are probed by the pieces at all their places, keys by their first PROBE characters (shorter keys by themselves): an
    equi-join whose candidates are then checked with contains. Names are distinct first, so a repeated name is probed once.
    """
    sizes = range(max(1, min(least, PROBE)), PROBE + 1)
    pieces = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substr(F.col(name), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    probes = names.select(name).distinct().filter(F.length(name) >= least).withColumn("__p", F.explode(F.array_distinct(F.flatten(F.array(*[pieces(n) for n in sizes])))))
    held = keys.filter((F.length("key") >= least) & (F.col("key") != "")).withColumn("__p", F.left("key", F.lit(PROBE)))
    return probes.join(held, "__p").filter(F.contains(name, F.col("key"))).select(name, "key", "value", "ord").distinct()


def lookup(names: DataFrame, name: str, keys: DataFrame, least: int, longest: bool = True) -> DataFrame:
    """Append (value, key) for each name: the value of the equal key, else of a contained key of ``least`` characters or more.

    Of several contained keys the longest wins (ties: the first in order), or with ``longest`` False the first in order. Equal keys: the first in order.
    """
    exact = keys.groupBy("key").agg(F.min_by("value", "ord").alias("__ev")).withColumnRenamed("key", "__ek")
    found = contained_keys(names, name, keys, least)
    rank = F.struct(-F.length("key"), F.col("ord")) if longest else F.struct(F.col("ord"))
    best = found.groupBy(name).agg(F.min_by(F.struct("value", "key"), rank).alias("__b"))
    out = names.join(exact, F.col(name) == F.col("__ek"), "left").join(best, name, "left")
    return out.withColumn("value", F.coalesce("__ev", "__b.value")).withColumn("key", F.coalesce("__ek", "__b.key")).drop("__ev", "__ek", "__b")


def prefix_lookup(left: DataFrame, a: str, right: DataFrame, b: str, order: str, least: int = 20, mark: str = "_") -> DataFrame:
    """Rows of left with the row of right whose name shares the longest prefix: one name is a prefix of the other, of ``least``
    characters or more, and where the longer goes on there is a ``mark``. Ties: the first in order.

    Either side's prefixes that end at a mark, and its whole names, meet the other side's whole names, so names that only begin alike never do.
    """

    def prefixes(df: DataFrame, c: str, whole: bool) -> DataFrame:
        """(c, __k): the prefixes of a name that end before a mark, and the name itself."""
        places = F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(F.col(c), i + 1, F.lit(1)) == mark) if not whole else F.array().cast("array<int>")
        return df.filter(F.length(c) >= least).withColumn("__k", F.explode(F.transform(F.filter(F.concat(places, F.array(F.length(c))), lambda n: n >= least), lambda n: F.left(F.col(c), n))))

    names, held = left.select(a).distinct(), right.select(b, order)
    shorter = prefixes(names, a, False).join(prefixes(held, b, True), "__k")
    longer = prefixes(names, a, True).join(prefixes(held, b, False), "__k")
    best = shorter.unionByName(longer).groupBy(a).agg(F.min_by(F.col(b), F.struct(-F.length("__k"), F.col(order))).alias(b))
    return left.join(best, a, "left")


def best_coverage(items: DataFrame, item: list[str], tokens: Column, targets: DataFrame, target: list[str], target_tokens: Column, least: float = 0.5) -> DataFrame:
    """For each item the target that holds the largest share of its distinct tokens (``least`` or more); ties by target. Gives (item, target, share).

    A target with that share holds one at least of the item's n - ceil(least * n) + 1 rarest tokens, so items and targets meet on those
    only; common words don't pair every item with every target. Shares of the pairs are counted on whole token sets.
    """
    a = items.select(*item, F.array_distinct(tokens).alias("__a")).filter(F.size("__a") > 0)
    b = targets.select(*target, F.array_distinct(target_tokens).alias("__b"))
    words = b.select(*target, F.explode("__b").alias("__t"))
    wanted = a.select(*item, F.size("__a").alias("__n"), F.explode("__a").alias("__t"))
    count = words.join(wanted.select("__t").distinct(), "__t").groupBy("__t").agg(F.count("*").alias("__f"))
    rank = F.row_number().over(Window.partitionBy(*item).orderBy(F.coalesce("__f", F.lit(0)), "__t"))
    rare = wanted.join(count, "__t", "left").withColumn("__r", rank).filter(F.col("__r") <= F.col("__n") - F.ceil(F.lit(least) * F.col("__n")) + 1)
    pairs = rare.select(*item, "__t").join(words, "__t").select(*item, *target).distinct()
    share = F.size(F.array_intersect("__a", "__b")) / F.size("__a")
    shares = pairs.join(a, item).join(b, target).select(*item, *target, share.alias("share")).filter(F.col("share") >= least)
    best = shares.groupBy(*item).agg(F.min(F.struct((-F.col("share")).alias("s"), *target)).alias("x"))
    return best.select(*item, *[F.col(f"x.{t}").alias(t) for t in target], (-F.col("x.s")).alias("share"))


def exactly_one(refs: DataFrame, ref_key: list[str], targets: DataFrame, target_key: list[str], value: str) -> DataFrame:
    """Resolve references: append ``value`` of the one target with the reference's key, null unless exactly one has it."""
    only = targets.groupBy(*target_key).agg(F.count("*").alias("__n"), F.min(value).alias(value)).filter("__n = 1").drop("__n")
    on = [F.col(f"__l.{r}") == F.col(f"__r.{t}") for r, t in zip(ref_key, target_key)]
    return refs.alias("__l").join(only.alias("__r"), on, "left").select("__l.*", f"__r.{value}")


def earlier_matches(events: DataFrame, notices: DataFrame, key: list[str], when: str, notice_id: str, whole: bool = False) -> DataFrame:
    """Append (latest, n_notices): of the notices of the same key at or before each event the id of the last one, and how many there are.

    Events and notices of a key are put in one order, so no (event, notice) pair is made. With ``whole`` all ids are gathered too, as ``notices``, in order of time: that
    column grows with the square of a key's rows and is for keys known to be small.
    """
    tagged = events.select(*key, when, *[c for c in events.columns if c not in (*key, when)], F.lit(None).cast("string").alias("__id"), F.lit(1).alias("__e"))
    other = notices.select(*key, when, F.col(notice_id).cast("string").alias("__id"), F.lit(0).alias("__e"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy(when, "__e", "__id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = {"latest": F.last("__id", ignorenulls=True).over(upto), "n_notices": F.count("__id").over(upto)} | ({"notices": F.collect_list("__id").over(upto)} if whole else {})
    return both.withColumns(found).filter("__e = 1").drop("__id", "__e")


def previous_of(rows: DataFrame, key: list[str], order: str, width: int = 1 << 20) -> DataFrame:
    """(key, order, previous): the next lower ``order`` (a long) of the same key; null for the first.

    Rows are compared within stretches of ``width`` numbers, and the first of a stretch with the highest of the stretches before: a key of any share of the rows is many tasks.
    """
    cut = rows.select(*key, F.col(order).cast("long").alias(order)).withColumn("__b", F.floor(F.col(order) / width))
    inner = cut.withColumn("__p", F.lag(order).over(Window.partitionBy(*key, "__b").orderBy(order)))
    last = cut.groupBy(*key, "__b").agg(F.max(order).alias("__m")).withColumn("__q", F.lag("__m").over(Window.partitionBy(*key).orderBy("__b"))).drop("__m")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*key, "__b")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return inner.alias("x").join(last.alias("y"), on).select(*[F.col(f"x.{c}") for c in key], f"x.{order}", F.coalesce("x.__p", "y.__q").alias("previous"))


def ancestors(nodes: DataFrame, node: str, parent: str, label: str) -> DataFrame:
    """(node, path): for every node with a parent the array of (node, label) from the root down to its parent.

    Chains double at every step, so a forest of any depth takes the logarithm of its depth in equi-joins; a cycle is an error.
    """
    up = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).filter("up is not null")
    names = nodes.select(F.col(node).alias("up"), F.struct(F.col(node).cast("string").alias("node"), F.col(label).cast("string").alias("label")).alias("own"))
    step = up.join(names, "up").select("node", "up", F.array("own").alias("path")).persist()
    count = nodes.count()
    reach = 1
    while True:
        further = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        longer = step.join(further, "up", "left")
        if longer.filter("next is not null").isEmpty():
            return step.select("node", "path")
        if reach > count:
            raise ValueError("nodes are their own ancestors")
        step = longer.select("node", F.coalesce("next", F.when(F.col("next").isNull(), F.col("up"))).alias("up"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path")).persist()
        reach *= 2


def parents(nodes: DataFrame, node: str, parent: str, label: str) -> DataFrame:
    """Append ``chain``: the labels from the root down to each node's parent, joined by ``>``; a parent that isn't there ends the chain."""
    above = ancestors(nodes, node, parent, label).select(F.col("node").alias("__of"), F.array_join(F.transform("path", lambda x: x["label"]), " > ").alias("__chain"))
    return nodes.join(above, F.col(node) == F.col("__of"), "left").withColumn("chain", F.coalesce("__chain", F.lit(""))).drop("__of", "__chain")


def descendants(nodes: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """(root, node) for every node below each root, at any depth."""
    above = ancestors(nodes.withColumn("__l", F.lit("")), node, parent, "__l")
    pairs = above.select("node", F.explode("path").alias("x")).select(F.col("x.node").alias("root"), "node")
    return pairs.join(roots.select(F.col(node).cast("string").alias("root")), "root", "left_semi").select("root", "node")
