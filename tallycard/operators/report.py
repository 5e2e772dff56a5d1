"""Summary tables that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycard.operators.prefix import exact_quantiles, running_totals

QUARTILES = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}


def count_of_counts(df: DataFrame, keys: list[str], outer: list[str]) -> DataFrame:
    """How many cells hold how many rows; more than one size per key hints at duplicates."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).groupBy(*outer, "count").agg(
        F.count("*").alias("n"))


def distinct_then_count(df: DataFrame, keys: list[str], outer: list[str]) -> DataFrame:
    return df.select(*keys).distinct().groupBy(*outer).agg(F.count("*").alias("n"))


def date_summary(df: DataFrame, column: str) -> DataFrame:
    """First, last, mean and median day of a date column."""
    days = df.filter(F.col(column).isNotNull()).groupBy(F.unix_date(column).alias("day")).agg(F.count("*").alias("n"))
    # days are whole numbers: a few ten thousand distinct ones at any table size, all summaries come from their counts
    ran = running_totals(days, [], "day", ["n"])
    as_date = lambda c: F.date_from_unix_date(F.floor(c).cast("int"))
    low, high = F.floor((F.col("tot_n") - 1) / 2), F.ceil((F.col("tot_n") - 1) / 2)
    at = lambda spot: F.max(F.when((F.col("cum_n") - F.col("n") <= spot) & (spot < F.col("cum_n")), F.col("day")))
    return ran.agg(
        as_date(F.min("day")).alias("first"), as_date(F.max("day")).alias("last"),
        as_date(F.sum(F.col("day") * F.col("n")) / F.sum("n")).alias("mean"),
        as_date((at(low) + at(high)) / 2).alias("median"))


def histogram(df: DataFrame, column: str, width: Column, by: list[str] = ()) -> DataFrame:
    """Counts per bin [k*width, (k+1)*width)."""
    bin_no = F.floor(F.col(column) / width)
    return df.filter(F.col(column).isNotNull()).groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("n"))


def spread_width(df: DataFrame, column: str, bins: int = 24) -> Column:
    """max(1, range / bins) as a scalar of the table."""
    spread = (F.max(column) - F.min(column)) / F.lit(bins)
    return df.agg(F.greatest(F.lit(1.0), spread.cast("double"))).scalar()


def five_number(df: DataFrame, by: list[str], column: str, wide: bool = True) -> DataFrame:
    return exact_quantiles(df, by, column, QUARTILES, wide=wide)


def share_of_group(counts: DataFrame, within: list[str], n: str = "n") -> DataFrame:
    """``share`` of a table of counts within its groups."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def unpivot_flags(df: DataFrame, ids: list[str], items: list[str], key: str = "item", value: str = "value") -> DataFrame:
    """Wide to long as a map-only step; values cast to int."""
    return df.select(*ids, *[F.col(i).cast("int").alias(i) for i in items]).unpivot(ids, items, key, value)


def item_prevalence(df: DataFrame, items: list[str]) -> DataFrame:
    """Rows, carriers and events among carriers per yes/no item; one pass, no long table."""
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.sum(F.col(i).cast("int")).alias(f"n_{i}") for i in items],
        *[F.sum((F.col(i) & F.col("is_event")).cast("int")).alias(f"e_{i}") for i in items],
        F.sum(F.col("is_event").cast("int")).alias("events"),
    )
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("item"), F.col("rows"), F.col("events"),
                 F.col(f"n_{i}").alias("carriers"), F.col(f"e_{i}").alias("carrier_events"))
        for i in items
    ])))


def log_odds(prevalence: DataFrame) -> DataFrame:
    """Smoothed log odds ratio of the event per item (half a count added to each cell)."""
    a = F.col("carrier_events") + 0.5
    b = F.col("carriers") - F.col("carrier_events") + 0.5
    c = F.col("events") - F.col("carrier_events") + 0.5
    d = F.col("rows") - F.col("events") - (F.col("carriers") - F.col("carrier_events")) + 0.5
    return prevalence.select("item", F.ln(a * d / (b * c)).alias("coef"))


def renumbered(df: DataFrame, by: list[str], order: list[Column], modulo: int, name: str = "number") -> DataFrame:
    """Replicate numbers 1..modulo in turn within a (small) group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, (F.pmod(F.row_number().over(w) - 1, F.lit(modulo)) + 1).cast("int"))


def shifted_to_zero(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) - F.min(column).over(Window.partitionBy(*by)))


def sorted_nulls_last(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Sort with missing values last in either direction; (column, descending)."""
    return df.orderBy(*[
        F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order
    ])


def joined_naturally(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all common columns."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left")
