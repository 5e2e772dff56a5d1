"""Running totals, positions and exact quantiles that do not need one big window.

A window ordered over a whole table is one task. Where the number of distinct
order values is not known to be small, the values are cut at approximate
quantiles into ranges, totals per range are prefix-summed (a small table), and
only the rows inside one range are ordered together.
"""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycard.functions.values import hash_key
from tallycard.session import settled

SLICE = "_slice"
#: Rows that are ordered together, about.
RANGE_ROWS = 1_000_000


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; key columns kept once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])


#: Quantiles that are asked for before the number of ranges is known.
FINE = 1000


def range_edges(df: DataFrame, order: str, parts: int | None) -> list[float]:
    """At most ``parts - 1`` cut values near the quantiles of ``order``, by default for ranges of ``RANGE_ROWS`` rows.

    Rows are counted in the same pass, with a fine list of quantiles that is thinned afterwards.
    """
    at = lambda many: F.percentile_approx(F.col(order).cast("double"), [i / many for i in range(1, many)], max(10000, 20 * many)).alias("e")
    if parts is None or parts <= FINE:
        found = df.agg(F.count("*").alias("n"), at(FINE)).first()
        if parts is None:  # enough ranges for the rows, and for the session's tasks
            parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found["n"] // RANGE_ROWS))
        fine = found["e"] or []
        edges = [fine[i * FINE // parts - 1] for i in range(1, parts) if i * FINE >= parts] if fine else []
    if parts > FINE:
        edges = df.agg(at(parts)).first()["e"] or []
    return sorted({e for e in edges if isfinite(e)})


def with_slice(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """Add the number of the value range each row falls into."""
    edges = range_edges(df, order, parts)
    if not edges:
        return df.withColumn(SLICE, F.lit(0))
    cut = Bucketizer(
        splits=[-float("inf"), *edges, float("inf")], inputCol="_order", outputCol=SLICE,
        handleInvalid="keep",
    )
    return (
        cut.transform(df.withColumn("_order", F.col(order).cast("double")))
        .drop("_order").withColumn(SLICE, F.col(SLICE).cast("int"))
    )


def running_totals(
    df: DataFrame,
    by: list[str],
    order: str,
    measures: list[str],
    descending: bool = False,
    wide: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add ``cum_<m>`` and ``tot_<m>`` for each measure, per group ``by``.

    ``df`` has at most one row per (by, order). ``wide=False`` is for few
    distinct order values per group (integer scores, categories); ``wide=True``
    handles any number of them. NULL order values are not allowed.
    """
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if not wide:
        w = Window.partitionBy(*by)
        run = w.orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns(
            {f"cum_{m}": F.sum(m).over(run) for m in measures}
            | {f"tot_{m}": F.sum(m).over(w) for m in measures}
        )
    cut = with_slice(settled(df), order, parts)
    keys = [*by, SLICE]
    group = Window.partitionBy(*by)
    before = group.orderBy(turn(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(*[F.sum(m).alias(f"in_{m}") for m in measures]).select(
        *keys,
        *[F.coalesce(F.sum(f"in_{m}").over(before), F.lit(0)).alias(f"off_{m}") for m in measures],
        *[F.sum(f"in_{m}").over(group).alias(f"tot_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys).orderBy(turn(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({f"cum_{m}": F.sum(m).over(inside) for m in measures})
    return (
        same_keys(local, settled(offsets), keys)
        .withColumns({f"cum_{m}": F.col(f"cum_{m}") + F.col(f"off_{m}") for m in measures})
        .drop(SLICE, *[f"off_{m}" for m in measures])
    )


def numbered(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Position 1, 2, … of every row of the table in the order of a unique column."""
    ran = running_totals(df.withColumn("_one", F.lit(1)), [], order, ["_one"], wide=True)
    return ran.withColumnRenamed("cum__one", name).drop("_one", "tot__one")


def values_at(df: DataFrame, order: str, positions: list[int]) -> DataFrame:
    """position and the value of a unique column that stands there, 1 being the least.

    Counts per range tell which ranges hold the positions; only those are ordered.
    """
    cut = with_slice(settled(df.select(order)), order)
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(SLICE).agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    wanted = counts.withColumn("position", F.explode(F.lit(positions).cast("array<bigint>"))).filter(
        (F.col("position") > F.col("_before")) & (F.col("position") <= F.col("_before") + F.col("_in")))
    wanted = settled(wanted.select(SLICE, (F.col("position") - F.col("_before")).alias("_rank"), "position"))
    near = cut.join(wanted.select(SLICE).distinct(), SLICE, "left_semi").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(SLICE).orderBy(order)).cast("long"))
    return near.join(wanted, [SLICE, "_rank"]).select("position", F.col(order).alias("value"))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], wide: bool = True
) -> DataFrame:
    """Interpolated quantiles per group, exact at any group size.

    Equal values are counted first, so a frequent value costs one row. Output
    columns are the names in ``probs``.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ran = running_totals(counts, by, value, ["_n"], wide=wide)
    first, last, total = F.col("cum__n") - F.col("_n"), F.col("cum__n"), F.col("tot__n")
    picks = []
    for name, p in probs.items():
        spot = (total - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        x = F.col(value).cast("double")
        picks += [
            F.max(F.when((first <= low) & (low < last), x)).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high < last), x)).alias(f"_hi_{name}"),
            F.max(spot - low).alias(f"_w_{name}"),
        ]
    lo = lambda n: F.col(f"_lo_{n}")
    return ran.groupBy(*by).agg(*picks).select(
        *by,
        *[(lo(n) + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - lo(n))).alias(n) for n in probs],
    )


# ---- positions by hash ----------------------------------------------------


#: Hash digits that name a range: 65,536 of them, so that a range of 10^10 rows is some 150,000.
DIGITS = 4


def _with_hash(df: DataFrame, key: str, seed: object, digits: int | None) -> DataFrame:
    """Adds the hash and its first digits."""
    hashed = df.withColumn("_hash", hash_key(seed, key))
    return hashed.withColumn(SLICE, F.substring("_hash", 1, DIGITS if digits is None else digits))


def _slice_counts(hashed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows per (stratum, hash prefix), rows before it, rows of the stratum."""
    w = Window.partitionBy(*strata)
    before = w.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*strata, SLICE).agg(F.count("*").alias("_in"))
    return counts.withColumns({
        "_before": F.coalesce(F.sum("_in").over(before), F.lit(0)),
        "_total": F.sum("_in").over(w),
    })


def hash_positions(
    df: DataFrame, strata: list[str], key: str, seed: object, digits: int | None = None, name: str = "position"
) -> DataFrame:
    """1-based position of each row inside its stratum, in the order of its hash.

    A stratum is spread over 16^digits windows.
    """
    hashed = _with_hash(df, key, seed, digits)
    inside = Window.partitionBy(*strata, SLICE).orderBy("_hash", key)
    ranked = hashed.withColumn("_rank", F.row_number().over(inside))
    counts = settled(_slice_counts(hashed, strata).drop("_in", "_total"))
    return (
        same_keys(ranked, counts, [*strata, SLICE])
        .withColumn(name, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_hash", SLICE, "_rank", "_before")
    )


def mark_first(
    df: DataFrame,
    strata: list[str],
    key: str,
    seed: object,
    wanted,
    name: str = "picked",
    digits: int | None = None,
) -> DataFrame:
    """Boolean ``name``: is the row among the first ``wanted(total)`` of its stratum?

    Counts per hash range tell in which one range of a stratum the border lies;
    only that range is ordered, which gives the last hash to take. The result is
    then a comparison row by row: the table itself is never shuffled. Without
    ``strata`` the whole table is one.
    """
    slim = _with_hash(df.select(*strata, key), key, seed, digits)
    counts = _slice_counts(slim, strata)
    goal = F.least(wanted(F.col("_total")), F.col("_total"))
    border = counts.withColumn("_take", goal - F.col("_before")).filter(
        (F.col("_take") > 0) & (F.col("_take") <= F.col("_in"))).select(*strata, SLICE, "_take")
    inside = Window.partitionBy(*strata, SLICE).orderBy("_hash", key)
    # one row per stratum: settled, so that the table is not shuffled for it
    near = same_keys(slim, settled(border), [*strata, SLICE]).withColumn("_rank", F.row_number().over(inside))
    last = near.filter(F.col("_rank") == F.col("_take")).select(
        *strata, F.struct(F.col("_hash").alias("h"), F.col(key).alias("k")).alias("_last"))
    here = F.struct(hash_key(seed, key).alias("h"), F.col(key).alias("k"))
    if not strata:
        return df.withColumn(name, F.coalesce(here <= settled(last).select("_last").scalar(), F.lit(False)))
    placed = same_keys(df, settled(last), strata, "left")
    return placed.withColumn(name, F.coalesce(here <= F.col("_last"), F.lit(False))).drop("_last")
