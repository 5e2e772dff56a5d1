"""Splits, folds and samples that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.operators.prefix import hash_positions, mark_first


def genotype_stratum(genotype: str = "genotype") -> Column:
    """ZZ, SZ, MM, and Ab for everything else, missing included."""
    g = F.col(genotype)
    return F.when(g.isin("SZ", "ZZ", "MM"), g).otherwise("Ab")


def fraction_of(share: float):
    return lambda total: F.floor(total * F.lit(float(share)))


def stratified_sample(df: DataFrame, strata: list[str], key: str, share: float, seed=settings.SEED) -> DataFrame:
    """floor(share * n) rows of every stratum, without replacement."""
    marked = mark_first(df, strata, key, seed, fraction_of(share))
    return marked.filter("picked").drop("picked")


def sample_fraction(df: DataFrame, key: str, share: float, seed=settings.SEED) -> DataFrame:
    """floor(share * n) rows of the whole table."""
    return stratified_sample(df, [], key, share, seed)


def sample_each(df: DataFrame, cells: list[str], key: str, n: int, seed=settings.SEED) -> DataFrame:
    """Up to ``n`` rows of every cell."""
    marked = mark_first(df, cells, key, seed, lambda total: F.least(total, F.lit(n)))
    return marked.filter("picked").drop("picked")


def split(df: DataFrame, strata: list[str], key: str, train: float, seed=settings.SEED) -> DataFrame:
    """Add ``split``: 'train' for floor(train * n) rows of every stratum, else 'test'."""
    marked = mark_first(df, strata, key, seed, fraction_of(train))
    return marked.withColumn("split", F.when(F.col("picked"), "train").otherwise("test")).drop("picked")


def folds(df: DataFrame, strata: list[str], key: str, v: int = settings.N_FOLDS, seed=settings.SEED) -> DataFrame:
    """Add ``fold`` 1..v; fold sizes inside a stratum differ by at most one."""
    placed = hash_positions(df, strata, key, seed)
    return placed.withColumn("fold", ((F.col("position") - 1) % v + 1).cast("int")).drop("position")


def fold_roles(df: DataFrame) -> DataFrame:
    """Per fold and role: rows and events. One pass; 'train' is total minus fold."""
    per_fold = df.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum(F.col("is_event").cast("long")).alias("events"))
    whole = Window.partitionBy()  # one row per fold
    rest = lambda c: F.sum(c).over(whole) - F.col(c)
    sides = per_fold.withColumns({"_n": rest("n"), "_events": rest("events")})
    return sides.select("fold", F.inline(F.array(
        F.struct(F.lit("test").alias("role"), F.col("n"), F.col("events")),
        F.struct(F.lit("train").alias("role"), F.col("_n").alias("n"), F.col("_events").alias("events")))))


def split_audit(assigned: DataFrame, key: str) -> DataFrame:
    """Ids, ids in both sets, ids listed more than once."""
    per_id = assigned.groupBy(key).agg(
        F.bool_or(F.col("split") == "train").alias("in_train"),
        F.bool_or(F.col("split") == "test").alias("in_test"),
        F.count("*").alias("times"),
    )
    both = F.col("in_train") & F.col("in_test")
    return per_id.agg(
        F.count("*").alias("ids"),
        F.sum(F.col("in_train").cast("long")).alias("train_ids"),
        F.sum(F.col("in_test").cast("long")).alias("test_ids"),
        F.sum(both.cast("long")).alias("in_both"),
        F.sum((F.col("times") > 1).cast("long")).alias("listed_twice"),
    )
