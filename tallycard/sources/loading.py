"""Loading a raw file: types that follow from its values, and the rows that do not fit them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard.session import settled

#: Types that are tried, the narrowest first; what fits none is text.
CANDIDATES = ["bigint", "double", "boolean", "date"]
MISSING = ["", "NA"]


@dataclass(frozen=True)
class Loaded:
    """``rows``: typed rows without a fault. ``rejected``: a row per fault, with the line's number of faults, column, reason and text."""

    rows: DataFrame
    rejected: DataFrame
    types: dict[str, str]


def _typed(value: Column, kind: str, date_pattern: str) -> Column:
    if kind == "date":
        return F.to_date(F.try_to_timestamp(value, F.lit(date_pattern)))
    if kind == "bigint":  # a cast would cut decimals off
        return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("bigint"))
    return value if kind == "string" else value.try_cast(kind)


def value_types(raw: DataFrame, columns: list[str], date_pattern: str, share: float) -> dict[str, str]:
    """The narrowest type that at least ``share`` of a column's known values have, from one aggregate."""
    known = [F.count(c).alias(f"{c}|known") for c in columns]
    fits = [F.count(_typed(F.col(c), k, date_pattern)).alias(f"{c}|{k}") for c in columns for k in CANDIDATES]
    found = raw.agg(*known, *fits).first()
    enough = lambda c, k: found[f"{c}|known"] > 0 and found[f"{c}|{k}"] >= share * found[f"{c}|known"]
    return {c: next((k for k in CANDIDATES if enough(c, k)), "string") for c in columns}


def load_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, date_pattern: str = "M/d/yyyy",
             share: float = 0.95, missing: list[str] = MISSING) -> Loaded:
    """A CSV file with a header row.

    Types are given, or follow from the values. A line with another number of fields than the header, and a value that
    is not of its column's type, put the line among the rejected; a missing value is no fault.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField("_line", T.StringType())])
    # the text of a line is set where its fields are not as many as the header's
    raw = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line").csv(path)
    raw = settled(raw.select(*[F.when(~F.trim(c).isin(missing), F.col(c)).alias(c) for c in header], "_line"))
    kinds = types or value_types(raw.filter("_line is null"), header, date_pattern, share)
    fault = lambda column, reason, value: F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"), value.alias("value"))
    odd = [F.when(F.col(c).isNotNull() & _typed(F.col(c), k, date_pattern).isNull(), fault(c, k, F.col(c))) for c, k in kinds.items() if k != "string"]
    faults = F.when(F.col("_line").isNotNull(), F.array(fault("", "fields", F.col("_line")))).otherwise(F.array_compact(F.array(*odd)) if odd else F.array())
    judged = settled(raw.select(*[_typed(F.col(c), k, date_pattern).alias(c) for c, k in kinds.items()], faults.alias("_faults")))
    rejected = judged.filter(F.size("_faults") > 0).select(F.size("_faults").alias("faults"), F.inline("_faults"))
    return Loaded(judged.filter(F.size("_faults") == 0).drop("_faults"), rejected, kinds)
