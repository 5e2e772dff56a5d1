"""Rank correlation of columns with any number of values.

Kendall's coefficients need the number of record pairs that two columns order
alike and unlike. Records are counted per pair of values, and each column is
cut into ranges at its approximate quantiles. A pair of records then falls in
exactly one of three places: in one range of the first column, in different
ranges of the first but one of the second, or in different ranges of both. The
first two are counted inside ranges, by one sort each; the third is the same
question about the small table of ranges, and is asked of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard.functions.values import ratio
from tallycard.operators.assoc import latent_rho_of_tau
from tallycard.session import settled

#: Records of a range, about, and ranges that one step leaves of many.
RANGE_ROWS, COARSER, FEW_RANGES = 500_000, 32, 512


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weight of the pairs that x and y order alike, less that of those ordered unlike; ties in either count nothing.

    Rows go in the order of x through the bits of y's rank, highest first: at each bit, rows with equal higher bits meet
    those of the other kind that stand before them.
    """
    order = np.lexsort((y, x))
    x, w = np.unique(x[order], return_inverse=True)[1], w[order].astype(np.float64)
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    total = 0.0
    for bit in range(int(rank.max()).bit_length() - 1 if len(rank) else -1, -1, -1):
        high = rank >> (bit + 1)
        by = np.argsort(high, kind="stable")
        h, wide = high[by], w[by]
        ones = ((rank[by] >> bit) & 1).astype(bool)
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[by][1:] != x[by][:-1])])
        first = np.repeat(start, np.diff(np.r_[start, len(h)]))  # the row's first tie in x
        group = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        base = np.repeat(group, np.diff(np.r_[group, len(h)]))  # the first row with these high bits
        before = [np.concatenate([[0.0], np.cumsum(np.where(kind, wide, 0.0))]) for kind in (~ones, ones)]
        zeros, others = (b[first] - b[base] for b in before)
        total += float(np.sum(wide * np.where(ones, zeros, -others)))
    return total


def _signed(pdf: pd.DataFrame) -> pd.DataFrame:
    found = signed_pairs(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy())
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "j": pdf["j"].iloc[:1], "s": [found]})


def value_ranges(df: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Adds the range number ``_r_<c>`` of every column: even between cut values, odd for a cut value itself.

    A frequent value is a cut value, so its range holds ties only.
    """
    probs = [k / parts for k in range(1, parts)]
    cuts = df.agg(*[F.percentile_approx(c, probs, max(10_000, 20 * parts)).alias(c) for c in columns]).first() if probs else {}
    for c in columns:
        edges = sorted({e for e in (cuts[c] or [] if probs else []) if isfinite(e)})
        if not edges:
            df = df.withColumn(f"_r_{c}", F.lit(0))
            continue
        cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol=c, outputCol="_slice", handleInvalid="error")
        at = F.col("_slice").cast("int")
        # the last range takes what equals its end, so each value is compared with the edge below it
        edge = F.get(F.lit(edges), at - 1)
        df = cut.transform(df).withColumn(f"_r_{c}", 2 * at - F.when(F.col(c) == edge, 1).otherwise(0)).drop("_slice")
    return df


def _bounded(df: DataFrame, u: str, v: str, by: list[str]) -> DataFrame:
    """Rows of groups that one task counts, by pair and range."""
    return df.groupBy("i", "j", *by, F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v")).agg(F.sum("w").alias("w"))


def tau_pairs(df: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS, coarser: int = COARSER, few: int = FEW_RANGES) -> DataFrame:
    """i, j, n, Kendall's tau_a and tau_b and the product-moment ``phi`` of every pair of columns, over complete rows.

    Columns are numbers, ordered codes or booleans, with any number of values; NaN and NULL make a row incomplete. Work
    grows with n log n. A range holds about ``range_rows`` rows, except those of one frequent value, which are ties and
    not counted. tau_b and phi of a constant column are NULL.
    """
    rows = settled(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]).dropna())
    n_rows = rows.count()
    parts = max(1, -(-n_rows // range_rows))
    ranged = value_ranges(rows, columns, parts)
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1:]]
    of = lambda a, b: F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(a).alias("x"), F.col(b).alias("y"),
                               F.col(f"_r_{a}").alias("sx"), F.col(f"_r_{b}").alias("sy"))
    cells = ranged.select(F.inline(F.array(*[of(a, b) for a, b in pairs]))).groupBy("i", "j", "sx", "sy", "x", "y").agg(F.count("*").cast("double").alias("w"))
    cells = settled(cells)
    tie = lambda c: ranged.groupBy(c).agg(F.count("*").cast("double").alias("m")).agg(F.lit(c).alias("column"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("ties"))
    ties = settled(reduce(DataFrame.unionByName, [tie(c) for c in columns]))

    steps, ranges = [], 2 * parts
    schema = "i string, j string, s double"
    while ranges > 0:
        # inside a range of the first column; then other ranges of the first, inside a range of the second. An odd
        # range of the values is one value: ties
        own = (F.col("sx") % 2 == 0) if not steps else F.lit(True)
        steps.append(_bounded(cells.filter(own), "x", "y", ["sx"]).groupBy("i", "j", "sx").applyInPandas(_signed, schema))
        own = (F.col("sy") % 2 == 0) if len(steps) < 2 else F.lit(True)
        steps.append(_bounded(cells.filter(own), "sx", "y", ["sy"]).groupBy("i", "j", "sy").applyInPandas(_signed, schema))
        cells = cells.groupBy("i", "j", F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.sum("w").alias("w"))
        if ranges <= few:
            break
        ranges //= coarser
        cells = settled(cells.withColumns({s: F.floor(F.col(c) / coarser).cast("int") for s, c in (("sx", "x"), ("sy", "y"))}))
    steps.append(_bounded(cells, "x", "y", []).groupBy("i", "j").applyInPandas(_signed, schema))
    signed = reduce(DataFrame.unionByName, steps).groupBy("i", "j").agg(F.sum("s").alias("s"))

    label = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("phi")) for a, b in pairs])
    moments = rows.agg(label.alias("p")).select(F.inline("p")) if pairs else df.sparkSession.createDataFrame([], "i string, j string, phi double")
    n = F.lit(float(n_rows))
    every = n * (n - 1) / 2
    left, right = (ties.select(F.col("column").alias(c), F.col("ties").alias(f"t{c}")) for c in ("i", "j"))
    found = moments.join(F.broadcast(signed), ["i", "j"], "left").join(F.broadcast(left), "i").join(F.broadcast(right), "j")
    s = F.coalesce("s", F.lit(0.0))
    return found.select("i", "j", F.lit(n_rows).cast("long").alias("n"), ratio(s, every).alias("tau_a"),
                        ratio(s, F.sqrt((every - F.col("ti")) * (every - F.col("tj")))).alias("tau_b"), "phi")


def level_shares(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """column and the cumulative shares of its levels below the last, or NULL for more than ``most`` levels: a number."""
    one = lambda c: df.groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "v", "n")
    counts = reduce(DataFrame.unionByName, [one(c) for c in columns])
    sizes = counts.groupBy("column").agg(F.count("*").alias("levels"), F.sum("n").alias("total"))
    few = counts.join(F.broadcast(sizes), "column").filter(F.col("levels") <= most)
    lists = few.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("v", (F.col("n") / F.col("total")).alias("share")))).alias("by"))
    lists = lists.select("column", F.transform("by", lambda s: s["share"]).alias("shares"))
    return sizes.join(F.broadcast(lists), "column", "left").select("column", "shares")


def latent_mixed(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """Correlation ``rho`` of the normals behind every pair of columns, and the tau-a that it implies.

    Columns of up to ``most`` values are categories, normals cut at thresholds; others are monotone images of normals.
    """
    rows = settled(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]).dropna())
    shares = level_shares(rows, columns, most)
    left, right = (shares.select(F.col("column").alias(c), F.col("shares").alias(f"of_{c}")) for c in ("i", "j"))
    facts = tau_pairs(rows, columns).join(F.broadcast(left), "i").join(F.broadcast(right), "j").select("i", "j", "n", "tau_a", "of_i", "of_j")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [latent_rho_of_tau(t, a, b) for t, a, b in zip(pdf["tau_a"], pdf["of_i"], pdf["of_j"])]
            yield pdf[["i", "j"]].assign(rho=[r for r, _ in found], tau=[t for _, t in found])

    return facts.mapInPandas(solve, "i string, j string, rho double, tau double")
