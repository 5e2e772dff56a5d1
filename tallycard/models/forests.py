"""Many forests of yes/no features at once, grown level by level in Spark.

A bootstrap draws each record a Poisson number of times, read off a hash of
record and tree. Draws are summed per pattern and tree, and from then on rows
are patterns, whatever the number of records. Every level of all trees of all
forests is one aggregate: rows and events per node and feature value. The best
split of each node is an expression over these sums, and a join moves the
patterns on. Patterns that are asked for travel along without weight, so their
leaves come out at the end. No tree passes the driver, and the same records give
the same trees for any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycard.models.knn import bit_code
from tallycard.session import settled

#: Hash prefixes from which on a Poisson(1) draw is at least 1, 2, …; the last has a probability of 1 in 10^9.
STEPS = [f"{int(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2 ** 32):08x}" for k in range(12)]


@dataclass(frozen=True)
class Family:
    """Trees that look at ``mtry`` features a split and leave a fold out (None: use all rows)."""

    number: int
    mtry: int
    leave_out: int | None = None


@dataclass(frozen=True)
class Forests:
    """``nodes``: every node with its rows, events and split (feature NULL: a leaf). ``leaves``: the leaf of every asked pattern in every tree."""

    nodes: DataFrame
    leaves: DataFrame


def draws(seed: object, *parts: Column) -> Column:
    """How often a record is in a tree's bootstrap."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8)
    # plain comparisons, which Spark compiles; the hash is computed once for all steps, as a common subexpression
    return reduce(Column.__add__, [(digits >= step).cast("int") for step in STEPS])


def drawn_patterns(rows: DataFrame, features: list[str], key: str, trees: int, seed: object, bootstrap: bool = True) -> DataFrame:
    """fold, tree, code, and the drawn rows ``n`` and events ``pos``; a record without fold has fold 0."""
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(0)
    plain = rows.select(F.col(key).alias("key"), fold.alias("fold"), F.col("is_event").cast("int").alias("event"), bit_code(features).alias("code"))
    each = plain.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
    each = each.withColumn("w", draws(seed, F.col("tree"), F.col("key")) if bootstrap else F.lit(1))
    # grouped by event as well, so that a record's draws enter one sum only
    counted = each.groupBy("fold", "tree", "code", "event").agg(F.sum("w").cast("long").alias("n"))
    return counted.groupBy("fold", "tree", "code").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("event")).alias("pos")).filter("n > 0")


def _best_split(features: list[str], seed: object, mtry: Column, depth_left: bool, least: int) -> Column:
    """The split of a node from its sums: struct of feature number and sums of the side where the feature is 1; NULL for none."""
    def side(k: int, f: str) -> Column:
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("family").cast("string"), F.col("tree").cast("string"), F.col("path"), F.lit(f)))
        return F.struct(draw.alias("draw"), F.lit(k).alias("feature"), F.col(f"n{k}").alias("n1"), F.col(f"pos{k}").alias("pos1"))

    looked = F.slice(F.sort_array(F.array(*[side(k, f) for k, f in enumerate(features)])), F.lit(1), mtry)
    n, pos = F.col("n"), F.col("pos")
    gain = lambda c: c["pos1"].cast("double") * c["pos1"] / c["n1"] + (pos - c["pos1"]).cast("double") * (pos - c["pos1"]) / (n - c["n1"])
    # both sides have rows, and their shares differ
    usable = F.filter(looked, lambda c: (c["n1"] > 0) & (c["n1"] < n) & (c["pos1"] * (n - c["n1"]) != (pos - c["pos1"]) * c["n1"]))
    best = F.array_max(F.transform(usable, lambda c: F.struct(gain(c).alias("gain"), (-c["feature"]).alias("first"), c["n1"].alias("n1"), c["pos1"].alias("pos1"))))
    return F.when(F.lit(depth_left) & (n >= 2 * least), best)


def grow_forests(rows: DataFrame, features: list[str], families: list[Family], trees: int, key: str = "record_id", seed: object = 1,
                 depth: int | None = None, least: int = 1, bootstrap: bool = True, asked: DataFrame | None = None) -> Forests:
    """Grow ``trees`` trees of every family on ``rows`` (key, is_event, features, and fold where one is left out).

    ``asked``: rows with the features whose leaves are wanted of every family; by default a family that leaves a fold
    out is asked for that fold's patterns. A smaller forest is the first trees of a larger one. Nodes under twice
    ``least`` drawn rows are not split.
    """
    drawn = settled(drawn_patterns(rows, features, key, trees, seed, bootstrap))
    family = F.lit([f.number for f in families])
    left_out = F.lit([-1 if f.leave_out is None else f.leave_out for f in families])
    mtries = F.create_map(*[F.lit(x) for f in families for x in (f.number, min(f.mtry, len(features)))])
    every = F.explode(F.arrays_zip(family.alias("family"), left_out.alias("left_out"))).alias("f")
    start = drawn.select(every, "*").select("f.*", "fold", "tree", "code", "n", "pos").filter("fold <> left_out").select(
        "family", "tree", "code", "n", "pos", F.lit(False).alias("asked"))
    number = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    if asked is None:
        fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(0)
        held = rows.select(fold.alias("fold"), bit_code(features).alias("code")).distinct()
        held = held.select(every, "*").select("f.*", "fold", "code").filter("fold = left_out").select("family", "code")
    else:
        held = asked.select(bit_code(features).alias("code")).distinct().select(F.explode(family).alias("family"), "code")
    held = held.select("family", number, "code", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(True).alias("asked"))
    at = settled(start.unionByName(held).groupBy("family", "tree", "code").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("asked").alias("asked")).withColumn("path", F.lit("")))

    bits = [F.substring("code", k + 1, 1) == "1" for k in range(len(features))]
    node = ["family", "tree", "path"]
    nodes, leaves, level = [], [], 0
    while True:
        sums = at.groupBy(*node).agg(
            F.sum("n").alias("n"), F.sum("pos").alias("pos"),
            *[F.sum(F.when(b, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, b in enumerate(bits) for c in ("n", "pos")])
        split = _best_split(features, seed, mtries[F.col("family")], depth is None or level < depth, least)
        found = sums.withColumn("split", split).select(
            *node, "n", "pos", (-F.col("split.first")).alias("feature"), F.col("split.n1").alias("n_high"), F.col("split.pos1").alias("pos_high"))
        found = settled(found)
        nodes.append(found)
        here = found.select(*node, "feature", F.col("n").alias("node_n"), F.col("pos").alias("node_pos"))
        more = not found.filter("feature is not null").isEmpty()
        # a tree that drew no row at all has no share
        share = F.when(F.col("node_n") > 0, F.col("node_pos") / F.col("node_n"))
        bit = F.substring(F.col("code"), F.col("feature") + 1, F.lit(1))
        path = F.concat("path", F.col("feature").cast("string"), F.when(bit == "1", ">").otherwise("<"))
        moved = at.join(here, node).filter("feature is not null or asked").select(
            "family", "tree", "code", "n", "pos", "asked", path.alias("path"), share.alias("share"))
        moved = settled(moved) if more else moved
        leaves.append(moved.filter("path is null").select("family", "tree", "code", "share"))
        if not more:
            break
        at = moved.filter("path is not null").drop("share")
        level += 1
    named = F.get(F.lit(features), F.col("feature"))
    return Forests(reduce(DataFrame.unionByName, nodes).withColumn("feature", named), reduce(DataFrame.unionByName, leaves))


def forest_shares(leaves: DataFrame, sizes: list[int]) -> DataFrame:
    """family, trees, code and ``p_event``: the mean share of the leaves of the first so many trees."""
    each = leaves.withColumn("trees", F.explode(F.lit(sizes))).filter("tree <= trees")
    # summed in one order, so that the last bits do not depend on the partitioning
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("tree", "share"))), F.lit(0.0), lambda acc, s: acc + F.coalesce(s["share"], F.lit(0.0)))
    return each.groupBy("family", "trees", "code").agg((total / F.count("share")).alias("p_event"))
