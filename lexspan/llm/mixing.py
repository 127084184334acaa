"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Places per level of the search for a source's last sampled document.
STEPS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of ``total`` times all sizes by weight.

    Sources by code point, null last, take ``weights`` in turn, repeating. No target exceeds ``most`` times its
    source's size; what that cuts off is shared again by weight until none is above: the sources are capped in the order
    of most * size / weight, and the level of the others follows in closed form from running sums. One row per source goes
    through these two windows, never a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights)).cast("int") + 1))
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        (F.lit(total) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    level = per.withColumn("level", level).withColumn("rank", F.row_number().over(up)).withColumn("open", F.lit(most) * F.col("source_size") >= F.col("level") * F.col("w"))
    # the first source that isn't capped gives the level of all that aren't
    level = level.withColumn("theta", F.min(F.when(F.col("open"), F.struct(F.col("rank"), F.col("level")))).over(everything)["level"])
    return level.select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.col("theta") * F.col("w")).alias("target"))


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from the md5 of the columns' text: the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in columns])), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def extra(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(s, scale, top, certain) of each source: inclusion probabilities are scale * sqrt(size) up to the size ``top``, and 1 beyond, where ``certain`` words lie.

    The scale makes the expected words of all the source's documents its need. It follows from running sums over the different sizes of a
    source, one row each, from the largest down: the first size whose probability stays below 1 settles it.
    """
    per = rows.filter("size > 0").groupBy(F.col("__s").alias("s"), "size").agg((F.count("*") * F.col("size")).alias("words"))
    per = per.join(goal.filter("need > 0").select(F.col("source").alias("__g"), "need"), F.col("s").eqNullSafe(F.col("__g")))
    down = Window.partitionBy("s").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scale = (F.col("need") - F.col("larger")) / F.sum(F.col("words") * F.sqrt("size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("larger", larger).withColumn("scale", scale)
    first = F.max(F.when(F.col("scale") * F.sqrt("size") < 1, F.struct("size", "scale", "larger")))
    return per.groupBy("s").agg(first.alias("x")).select("s", F.col("x.scale").alias("scale"), F.col("x.size").alias("top"), F.col("x.larger").alias("certain"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, most: int = 2, carry: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source") -> DataFrame:
    """Append (size, source_size, target, copies, taken) to ``carry`` for every row of ``docs``.

    Size is the number of words (null text: 0). A source's words should be taken target / source_size times. The whole part is
    allocated to all its documents as certain copies. Of the rest every document has an inclusion probability p of its own that grows with the root of its
    size, so that repeats go to documents more than to fragments, and such that the expected words are the source's need; where p would pass 1 the copy is certain too. The others
    are a Pareto order sample: they are ranked by the odds of their random number divided by the odds of p, and the first ones in that order are taken
    until the need is met as nearly as the last document allows, a fixed size in words. The random number
    comes from doc_id and text, so reruns agree and the rank of one document doesn't depend on others.

    The last document is found without sorting a source: sizes are summed in STEPS places of the order, then
    in STEPS places of the one place where the target falls, and a window orders only what is left there. A source of any
    share of the rows costs the same. Repeated rows are equal in rank and each count; rows with equal rank are taken in the
    order of their sizes. Sources of size 0, among them those with null or empty texts only, have target 0 and take nothing.
    An empty table gives an empty result; input columns named like the new ones are replaced.
    """
    new = {"size", "source_size", "target", "copies", "taken"}
    held = [c for c in carry if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.col(source).alias("__s"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform(F.col("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("__u"))
    rows = materialize(rows)
    goal = materialize(targets(rows.select(F.col("__s").alias("source"), "size"), weights, total, float(most)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).filter("source_size > 0 or ratio = 0")
    rest = extra(rows, goal)
    goal = goal.withColumnRenamed("source", "__s1").join(rest.withColumnRenamed("s", "__s2"), F.col("__s1").eqNullSafe(F.col("__s2")), "left")
    goal = materialize(goal.select("__s1", "source_size", "target", "whole", "scale", "top", (F.col("need") - F.coalesce("certain", F.lit(0))).alias("need")))
    # one row per source, a table of checked size: broadcast only where Spark's own threshold allows
    ranked = rows.join(goal, F.col("__s").eqNullSafe(F.col("__s1")))
    p = F.when((F.col("size") > 0) & (F.col("size") <= F.col("top")), F.col("scale") * F.sqrt("size"))
    ranked = ranked.withColumn("p", p).withColumn("__sure", F.coalesce(F.col("size") > F.col("top"), F.lit(False)))
    # the rank, turned into (0, 1) without changing the order
    odds = F.when(F.col("p") > 0, (F.col("__u") / (1 - F.col("__u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = ranked.withColumn("__q", odds).withColumn("__x", F.col("__q") / (1 + F.col("__q")))
    ranked = ranked.withColumn("__one", F.least(F.floor(F.col("__x") * STEPS), F.lit(STEPS - 1))).withColumn("__two", F.least(F.floor((F.col("__x") * STEPS - F.col("__one")) * STEPS), F.lit(STEPS - 1)))
    sums = materialize(ranked.filter("p > 0").groupBy(F.col("__s").alias("s"), F.col("__one").alias("one"), F.col("__two").alias("two")).agg(F.sum("size").alias("words"), F.max("need").alias("need")))
    # where each source's running sum meets its need: one place on the first level, then on the second
    one = Window.partitionBy("s").orderBy("one")
    first = sums.groupBy("s", "one").agg(F.sum("words").alias("words"), F.max("need").alias("need")).withColumn("upto", F.sum("words").over(one))
    first = first.filter("upto > need").groupBy("s").agg(F.min(F.struct("one", (F.col("upto") - F.col("words")).alias("before"))).alias("m")).select("s", F.col("m.one").alias("c1"), F.col("m.before").alias("b1"))
    first = materialize(first)
    two = Window.partitionBy("s").orderBy("two")
    second = sums.join(first.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1")) & (F.col("one") == F.col("c1"))).withColumn("upto", F.col("b1") + F.sum("words").over(two))
    second = second.filter("upto > need").groupBy("s").agg(F.min(F.struct("two", (F.col("upto") - F.col("words")).alias("before"), "c1")).alias("m")).select("s", F.col("m.c1").alias("c1"), F.col("m.two").alias("c2"), F.col("m.before").alias("b2"))
    second = materialize(second)
    placed = ranked.join(second.withColumnRenamed("s", "__s3"), F.col("__s").eqNullSafe(F.col("__s3")), "left")
    ahead = (F.col("__one") < F.col("c1")) | ((F.col("__one") == F.col("c1")) & (F.col("__two") < F.col("c2")))
    there = (F.col("__one") == F.col("c1")) & (F.col("__two") == F.col("c2"))
    out = [*[F.col(f"`{c}`") for c in held], "size", "source_size", "target"]
    settled = placed.filter(~F.coalesce(there & (F.col("p") > 0), F.lit(False)))
    settled = settled.select(*out, (F.col("whole") + F.when(F.col("__sure"), 1).when(F.col("p") > 0, F.when(F.col("c1").isNull(), 1).when(ahead, 1).otherwise(0)).otherwise(0)).alias("copies"))
    # a millionth of a source: its documents in order, up to the one whose inclusion is nearest to the need
    last = Window.partitionBy("__s").orderBy("__q", "size").rowsBetween(Window.unboundedPreceding, 0)
    final = placed.filter(F.coalesce(there, F.lit(False)) & (F.col("p") > 0)).withColumn("__upto", F.col("b2") + F.sum("size").over(last))
    final = final.select(*out, (F.col("whole") + F.when(F.col("__upto") - F.col("size") / 2 <= F.col("need"), 1).otherwise(0)).alias("copies"))
    return settled.unionByName(final).withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
