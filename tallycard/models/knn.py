"""Nearest neighbours among yes/no features by Hamming distance.

Records are counted per pattern first. Patterns asked for and training patterns
are dealt into blocks of equal numbers of ones, and Spark joins the blocks as a
grid: every cell adds up, for each of its asked patterns and each distance, how
many training records lie that far away, and only these sums leave it. Two
patterns are at least as far apart as their numbers of ones, so where the k
nearest are wanted, near cells come first and patterns that have enough drop out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycard.session import settled

#: Patterns asked for, and training patterns, in a block; cells of the grid that are counted in one go, near or far.
ASKED_BLOCK, TRAIN_BLOCK, FEW_CELLS = 4096, 16_384, 256


def bit_code(features: list[str]) -> Column:
    """All features of a record as one text of zeros and ones; any number of them."""
    return F.concat(*[F.col(f).cast("int").cast("string") for f in features])


def _bits(codes: str, width: int) -> np.ndarray:
    return (np.frombuffer(codes.encode(), np.uint8).reshape(-1, width) - ord("0")).astype(np.float32)


def _cell_sums(width: int, keys: list[str]):
    """Per key, asked pattern and distance: training rows and events of one cell of the grid."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell in pdf.to_dict("records"):
                asked, train = _bits(cell["asked"], width), _bits(cell["train"], width)
                which = pd.DataFrame({k: np.asarray(cell[f"k_{k}"], dtype=object) for k in keys}, index=range(len(train)))
                owners = which.groupby(keys, sort=False, dropna=False).indices if keys else {(): np.arange(len(train))}
                flat = np.arange(len(asked))[:, None] * (width + 1)
                for key, own in owners.items():
                    total = np.zeros((2, len(asked) * (width + 1)))
                    for at in range(0, len(own), 1024):
                        rows = own[at: at + 1024]
                        x = train[rows]
                        # differing places of 0/1 vectors
                        apart = asked.sum(1)[:, None] + x.sum(1)[None, :] - 2 * asked @ x.T
                        slots = (flat + np.rint(apart).astype(np.int64)).ravel()
                        for k, name in enumerate(("n", "pos")):
                            weight = np.broadcast_to(np.asarray(cell[name], float)[rows], apart.shape).ravel()
                            total[k] += np.bincount(slots, weight, minlength=total.shape[1])
                    at = np.flatnonzero(total[0])
                    codes = np.array([cell["asked"][k * width:(k + 1) * width] for k in range(len(asked))], dtype=object)
                    out = pd.DataFrame({"code": codes[at // (width + 1)], "distance": at % (width + 1),
                                        "n": total[0, at].astype(np.int64), "pos": total[1, at].astype(np.int64)})
                    for name, value in zip(keys, key if isinstance(key, tuple) else (key,)):
                        out[name] = value
                    yield out

    return count


def _blocks(coded: DataFrame, size: int, number: str, columns: dict[str, Column]) -> DataFrame:
    """One row per block of patterns with equally many ones: its number, the ones, and a list per column."""
    ones = coded.withColumn("ones", F.length("code") - F.length(F.replace("code", F.lit("1"), F.lit(""))))
    # at most a row per feature and one
    counts = {r["ones"]: r["count"] for r in ones.groupBy("ones").count().collect()}
    of = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-n // size))]) if counts else F.lit(None).cast("map<int,int>")
    dealt = ones.withColumn("part", F.pmod(F.xxhash64("code"), of[F.col("ones")].cast("long")))
    rows = F.collect_list(F.struct(*[c.alias(k) for k, c in columns.items()]))
    packed = dealt.groupBy("ones", "part").agg(rows.alias("rows"))
    return packed.select(F.concat_ws("-", "ones", "part").alias(number), "ones", *[F.col("rows").getField(k).alias(k) for k in columns])


def shells(pats: DataFrame, features: list[str], keys: list[str] = (), wanted: DataFrame | None = None,
           enough: int | None = None, asked_block: int = ASKED_BLOCK, train_block: int = TRAIN_BLOCK, few_cells: int = FEW_CELLS) -> DataFrame:
    """For every wanted pattern and distance: training rows (n) and events (pos) that far away.

    ``wanted`` are the rows whose patterns are asked for, by default the training patterns themselves. With ``enough``,
    a pattern's shells end where that many training rows are reached, whichever one value of ``keys`` is left out; all
    shells that are given are whole. No pattern passes the driver, and rows and events per pattern and distance, never
    pairs of patterns, are what is shuffled besides the blocks.
    """
    keys, width = list(keys), len(features)
    train = settled(pats.select(*keys, bit_code(features).alias("code"), F.col("n").cast("long"), F.col("pos").cast("long")))
    asked = settled((pats if wanted is None else wanted).select(bit_code(features).alias("code")).distinct())
    blocks = settled(_blocks(train, train_block, "t", {"code": F.col("code"), "n": F.col("n"), "pos": F.col("pos"), **{f"k_{k}": F.col(k) for k in keys}})
                     .withColumn("train", F.array_join("code", "")).drop("code"))
    types = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    schema = ", ".join(["code string, distance int, n long, pos long", *[f"{k} {types[k]}" for k in keys]])
    found, limits, low, high = [], [], 0, width if enough is None else 1
    while True:
        mine = settled(_blocks(asked, asked_block, "a", {"code": F.col("code")}).withColumn("asked", F.array_join("code", "")).drop("code"))
        if not found and mine.count() * blocks.count() <= few_cells:
            high = width
        # which blocks meet is a matter of their numbers of ones
        gaps = F.lit(sorted({s * g for g in range(low, high + 1) for s in (1, -1)}))
        grid = mine.select("a", F.explode(F.transform(gaps, lambda g: F.col("ones") + g)).alias("ones")).join(blocks.select("t", "ones"), "ones").select("a", "t")
        cells = grid.join(mine.select("a", "asked"), "a").join(blocks.drop("ones"), "t").repartition("a", "t").drop("a", "t")
        found.append(settled(cells.mapInPandas(_cell_sums(width, keys), schema).groupBy(*keys, "code", "distance").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))))
        if high >= width:
            limits.append(asked.withColumn("limit", F.lit(width)))
            break
        # all training patterns up to this far away have been met
        seen = reduce(DataFrame.unionByName, found).filter(F.col("distance") <= high).groupBy("code", *keys).agg(F.sum("n").alias("n"))
        least = F.sum("n") - F.max("n") if keys else F.sum("n")
        reached = settled(asked.join(seen.groupBy("code").agg(least.alias("n")).filter(F.col("n") >= enough), "code").select("code"))
        limits.append(reached.withColumn("limit", F.lit(high)))
        asked = settled(asked.join(reached, "code", "left_anti"))
        if asked.isEmpty():
            break
        low, high = high + 1, min(width, 2 * high + 1)
    if len(found) == 1 and high >= width:
        return found[0].select(*keys, "code", "distance", "n", "pos")
    whole = reduce(DataFrame.unionByName, found).join(reduce(DataFrame.unionByName, limits), "code").filter("distance <= limit")
    return whole.groupBy(*keys, "code", "distance").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def without_fold(by_fold: DataFrame, v: int) -> DataFrame:
    """Shells of everything but the fold (1..v), from shells kept per fold."""
    total = by_fold.groupBy("code", "distance").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    every = total.withColumn("fold", F.explode(F.lit(list(range(1, v + 1)))))
    rest = every.join(by_fold, ["code", "distance", "fold"], "left").select(
        "fold", "code", "distance", (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"),
        (F.col("_pos") - F.coalesce("pos", F.lit(0))).alias("pos"))
    return rest.filter("n > 0")


def neighbour_share(near: DataFrame, k: Column, kernel: str, keys: list[str] = ()) -> DataFrame:
    """Weighted event share among the k nearest training records of every pattern.

    Whole shells are used; of the last one only the rows still missing to k
    count, each carrying the shell's event share, so order does not matter.
    'triangular' weights fall to zero at the distance of neighbour k + 1.
    """
    w = Window.partitionBy(*keys, "code").orderBy("distance")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ran = near.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("n"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("_before")))
    beyond = F.when(F.col("_upto") >= k + 1, F.col("distance"))
    # the first shell that reaches k + 1 rows holds neighbour k + 1
    edge = F.coalesce(F.min(beyond).over(Window.partitionBy(*keys, "code")),
                      F.max("distance").over(Window.partitionBy(*keys, "code")) + 1)
    weight = F.lit(1.0) if kernel == "rectangular" else F.lit(1.0) - F.col("distance") / (edge + F.lit(1e-6))
    weighed = ran.withColumns({"_taken": taken, "_w": weight}).filter("_taken > 0")
    mass = F.col("_taken") * F.col("_w")
    return weighed.groupBy(*keys, "code").agg(
        (F.sum(mass * F.col("pos") / F.col("n")) / F.sum(mass)).alias("p_event"))


def knn_predict(train_pats: DataFrame, test: DataFrame, features: list[str], k: int, kernel: str) -> DataFrame:
    """``test`` with p_event: the event share of the k nearest training records.

    ``test`` may be patterns or records; the shares are one row per pattern and
    are broadcast if that is few, so a frequent pattern is no hot join key.
    """
    share = neighbour_share(shells(train_pats, features, wanted=test, enough=k + 1), F.lit(k), kernel)
    return test.withColumn("code", bit_code(features)).join(settled(share), "code", "left").drop("code")
