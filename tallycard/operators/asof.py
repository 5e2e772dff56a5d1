"""Nearest-value match of two tables, for any number of rows on both sides and any group sizes.

Distinct values of both sides are merged in ranges of the value. Inside a range
the last known row is carried by a window; what stands before and after a range
comes from the ends of all ranges, a small table per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycard.operators.prefix import SLICE, same_keys, with_slice
from tallycard.session import settled


def _carried(cut: DataFrame, keys: list[str], value: str, forward: bool, equal: bool) -> DataFrame:
    """Adds the nearest hit before (or after) each row, over all ranges of its group."""
    turn = F.desc if forward else F.asc
    inside = Window.partitionBy(*keys, SLICE).orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, 0 if equal else -1)
    name = "above" if forward else "below"
    local = cut.withColumn(name, F.last("hit", ignorenulls=True).over(inside))
    end = F.min_by("hit", value) if forward else F.max_by("hit", value)
    ends = cut.filter("hit is not null").groupBy(*keys, SLICE).agg(end.alias("end"))
    slices = cut.select(*keys, SLICE).distinct()
    over = Window.partitionBy(*keys).orderBy(turn(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = same_keys(slices, ends, [*keys, SLICE], "left").withColumn("carry", F.last("end", ignorenulls=True).over(over)).drop("end")
    return same_keys(local, settled(carry), [*keys, SLICE]).withColumn(name, F.coalesce(name, "carry")).drop("carry")


def asof_match(left: DataFrame, right: DataFrame, keys: list[str], value: str, payload: list[str], prefer: list[str],
               equal: bool = True, parts: int | None = None) -> DataFrame:
    """``left`` with the structs ``below`` and ``above``: the right rows nearest to ``value`` on either side, in the same group.

    The structs hold ``value`` and ``payload``; they are NULL where there is no such row. Of right rows with one value
    that with the least ``prefer`` columns counts. With ``equal`` a row of the very value is nearest on both sides,
    without it values must differ. NULL keys form a group; a NULL value matches nothing, on either side. ``parts`` is
    the number of ranges, by default from the number of distinct values.
    """
    row = F.struct(value, *payload)
    hits = right.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.min_by(row, F.struct(*prefer)).alias("hit"), F.lit(False).alias("asked"))
    # many rows of one value are one target
    targets = left.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(True).alias("asked"))
    merged = hits.unionByName(targets, allowMissingColumns=True).groupBy(*keys, value).agg(
        F.first("hit", ignorenulls=True).alias("hit"), F.max("asked").alias("asked"))
    cut = settled(with_slice(settled(merged), value, parts))
    found = _carried(_carried(cut, keys, value, False, equal), keys, value, True, equal)
    return same_keys(left, settled(found.filter("asked").select(*keys, value, "below", "above")), [*keys, value], "left")


def nearest(matched: DataFrame, value: str, name: str = "nearest", upper: bool = False) -> DataFrame:
    """Adds the closer of ``below`` and ``above``; at equal distance the lower, or the upper one."""
    low, high = F.col(value) - F.col(f"below.{value}"), F.col(f"above.{value}") - F.col(value)
    first = high <= low if upper else high < low
    return matched.withColumn(name, F.when(F.col("below").isNull() | F.coalesce(first, F.lit(False)), F.col("above")).otherwise(F.col("below")))
