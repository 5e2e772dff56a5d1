"""Two-stage prediction: P(abnormal), then P(ZZ | abnormal)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard.models.batch_fit import FitSpec, fit_many
from tallycard.models.linear import LinearFit
from tallycard.operators.encode import Encoder
from tallycard.session import settled

STAGE_TWO = {
    "Dx": [],
    "Dx,age": ["age_guess"],
    "Dx,age,cigarette": ["age_guess", "smoking_history_cigarette"],
    "Dx,age,exposure": ["age_guess", "any_tobacco_exposure"],
}


def with_classes(df: DataFrame) -> DataFrame:
    """abnormal: SZ or ZZ; is_zz only among the abnormal."""
    g = F.col("genotype")
    df = df.filter(g.isNotNull()).withColumn("abnormal", g.isin("SZ", "ZZ"))
    return df.withColumn("is_zz", F.when(F.col("abnormal"), g == "ZZ"))


def abnormal_shares(train: DataFrame) -> DataFrame:
    """Baseline P(ZZ | abnormal) and P(SZ | abnormal) from counts."""
    return train.filter("abnormal").agg(
        F.avg(F.col("is_zz").cast("int")).alias("p_zz"), F.avg((~F.col("is_zz")).cast("int")).alias("p_sz"))


@dataclass(frozen=True)
class Stages:
    """P(abnormal) from the history of everyone, and P(ZZ | abnormal) of every specification among the abnormal."""

    encoder: Encoder
    first: LinearFit
    second: dict[str, LinearFit]
    #: Share of ZZ among the abnormal.
    baseline: float


def fit_stages(train: DataFrame, history: list[str], specs: dict[str, list[str]] = STAGE_TWO) -> Stages:
    """All stages and specifications, fitted together: one pass over the records per Newton step.

    Age is continuous, so the fits run on records and not on patterns. Columns are coded once, for everyone; a feature
    that is constant among a fit's own rows has the coefficient 0. A record that misses a column of one specification is
    used by the others.
    """
    columns = list(dict.fromkeys([*history, *[c for extra in specs.values() for c in extra]]))
    enc = Encoder(columns, carry=["n", "abnormal", "pos", "zz"]).fit(train)
    marks = {"n": F.lit(1), "pos": F.col("abnormal").cast("int"), "zz": F.coalesce(F.col("is_zz").cast("int"), F.lit(0))}
    rows = settled(enc.transform(train.withColumns(marks)))
    of = lambda names: tuple(f for c in names if c in enc.kept for f in enc.coded(c))
    fits = fit_many(rows, [
        FitSpec("abnormal", of(history), complete=True),
        *[FitSpec(f"zz|{name}", of([*history, *extra]), only="abnormal", events="zz", complete=True) for name, extra in specs.items()]])
    return Stages(enc, fits["abnormal"], {name: fits[f"zz|{name}"] for name in specs}, abnormal_shares(train).first()["p_zz"])


def bound(stages: Stages, df: DataFrame, keep: list[str]) -> DataFrame:
    """All predictions of every row side by side, from one projection: no join, no stacking.

    p_abnormal; p_zz_base with the baseline share; per specification ``p_zz | …`` and, given abnormal, ``p_zz_abnormal | …``.
    """
    enc = replace(stages.encoder, carry=keep)
    first = stages.first.p_event()
    given = {name: fit.p_event() for name, fit in stages.second.items()}
    return enc.transform(df).select(
        *keep, first.alias("p_abnormal"), (first * F.lit(stages.baseline)).alias("p_zz_base"),
        *[p.alias(f"p_zz_abnormal | {name}") for name, p in given.items()], *[(first * p).alias(f"p_zz | {name}") for name, p in given.items()])


def two_stage(train: DataFrame, test: DataFrame, history: list[str], keep: list[str]) -> DataFrame:
    """Predictions of every second-stage specification, stacked: p_abnormal, p_zz_given_abnormal, and p_zz, their product."""
    stages = fit_stages(train, history)
    one = lambda name: F.struct(F.lit(name).alias("predictors"), F.col(f"p_zz_abnormal | {name}").alias("p_zz_given_abnormal"), F.col(f"p_zz | {name}").alias("p_zz"))
    wide = bound(stages, test, keep)
    return wide.select(*keep, "p_abnormal", F.inline(F.array(*[one(name) for name in stages.second]))).select(
        *keep, "predictors", "p_abnormal", "p_zz_given_abnormal", "p_zz")
