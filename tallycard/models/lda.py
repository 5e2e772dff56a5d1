"""Linear discriminant from class counts, sums and cross products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard.models.linear import LinearFit


def lda_moments(df: DataFrame, features: list[str], event: str = "is_event") -> DataFrame:
    """Per class: rows, sum of each feature, sum of each product; long form.

    A single aggregate with one partial row per class and task.
    """
    x = {f: F.col(f).cast("double") for f in features}
    slots = [("", "", F.lit(1.0))] + [(f, "", x[f]) for f in features]
    slots += [(f, g, x[f] * x[g]) for i, f in enumerate(features) for g in features[i:]]
    sums = df.groupBy(F.col(event).alias("is_event")).agg(*[F.sum(e).alias(f"s{k}") for k, (_, _, e) in enumerate(slots)])
    return sums.select("is_event", F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{k}").alias("total"))
        for k, (a, b, _) in enumerate(slots)
    ])))


def fit_lda(moments: DataFrame, features: list[str]) -> LinearFit:
    """Posterior log odds as a linear score; pooled covariance over n - 2."""
    cell = {(r["is_event"], r["a"], r["b"]): r["total"] for r in moments.collect()}  # features^2 numbers
    p = len(features)
    n, mean, within = {}, {}, np.zeros((p, p))
    for c in (True, False):
        n[c] = cell[(c, "", "")]
        mean[c] = np.array([cell[(c, f, "")] for f in features]) / n[c]
        cross = np.zeros((p, p))
        for i, f in enumerate(features):
            for j in range(i, p):
                cross[i, j] = cross[j, i] = cell[(c, f, features[j])]
        within += cross - n[c] * np.outer(mean[c], mean[c])
    pooled = within / (n[True] + n[False] - 2)
    w = np.linalg.lstsq(pooled, mean[True] - mean[False], rcond=None)[0]
    b0 = -0.5 * (mean[True] + mean[False]) @ w + np.log(n[True] / n[False])
    return LinearFit(float(b0), dict(zip(features, map(float, w))))
