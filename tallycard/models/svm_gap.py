"""How far a support vector machine can be from the best one: primal value less a dual bound.

The bound comes from multipliers that are feasible for the dual problem, and no
machine whatever has a lower primal value. They are found by Newton steps on a
smoothed hinge over the pattern table, with less and less smoothing: where the
smooth loss is least, its slopes are feasible multipliers. Every step is one
aggregate, and sums per feature pair are all that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard.models.batch_fit import summed
from tallycard.models.linear import balanced_weights
from tallycard.models.svm import SvmFit
from tallycard.operators.encode import assembled
from tallycard.session import settled

#: Half widths of the smoothed bend of the hinge; step lengths and dampings that are tried at once.
BENDS, LENGTHS, DAMPINGS = (1.0, 0.2, 0.04, 0.008, 0.003), (1.0, 0.6, 0.3, 0.1, 0.03, 0.01, 0.003), (1e-9, 1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0)


@dataclass(frozen=True)
class Gap:
    """``primal`` of a machine, ``dual`` of the multipliers, below every machine; ``polished``: the value of ``coefs``, ``intercept``."""

    primal: float
    dual: float
    polished: float
    coefs: np.ndarray
    intercept: float


def _smooth(m: np.ndarray, bend: float) -> np.ndarray:
    return np.where(m >= 1 + bend, 0.0, np.where(m <= 1 - bend, 1 - m, (1 + bend - m) ** 2 / (4 * bend)))


def _slope(m: np.ndarray, bend: float) -> np.ndarray:
    """Minus the slope of the smoothed hinge, from 0 to 1."""
    return np.clip((1 + bend - m) / (2 * bend), 0.0, 1.0)


def machine_table(rows: DataFrame, fit: SvmFit) -> DataFrame:
    """x (the machine's features), y (-1, 1), w of weighted patterns, as the machine was given them."""
    weighed = balanced_weights(rows)
    if fit.linear:
        x = F.array(*[F.col(f).cast("double") for f in fit.features])
    else:
        weighed = fit.expansion.transform(assembled(weighed, fit.features))
        x = vector_to_array("expanded")
    return settled(weighed.select(x.alias("x"), (2 * F.col("label") - 1).alias("y"), F.col("weight").alias("w")))


def duality_gap(table: DataFrame, coefs: np.ndarray, intercept: float, penalty: float) -> Gap:
    """Primal value of the machine ``coefs``, ``intercept`` on ``table``, and a dual bound on that of every machine.

    The objective is the weighted mean hinge loss plus penalty / 2 times the squared coefficients of features divided by
    their spread; the intercept is free.
    """
    p = len(coefs)
    data = lambda pdf: (np.stack(pdf["x"].to_list()).reshape(-1, p), pdf["y"].to_numpy(float), pdf["w"].to_numpy(float))
    vector = lambda found, k, size: np.array([found.get((k, s), 0.0) for s in range(size)])

    def moments(pdf: pd.DataFrame) -> dict:
        x, _, w = data(pdf)
        return {0: np.concatenate([[w.sum()], w @ x, w @ (x * x)])}

    v = vector(summed(table, moments), 0, 1 + 2 * p)
    total, mean = v[0], v[1:1 + p] / v[0]
    spread = np.sqrt(np.maximum(v[1 + p:] / total - mean ** 2, 0.0) * total / max(total - 1, 1e-9))
    scale = np.where(spread > 0, spread, 1.0)

    def scaled(pdf: pd.DataFrame):
        x, y, w = data(pdf)
        return np.column_stack([np.ones(len(x)), x / scale]), y, w / total

    ridge = np.concatenate([[0.0], np.full(p, penalty)])
    now = np.zeros(p + 1)
    for bend in BENDS:
        for _ in range(30):
            def curvature(pdf: pd.DataFrame, now=now, bend=bend) -> dict:
                z, y, w = scaled(pdf)
                m = y * (z @ now)
                inside = w * (np.abs(m - 1) < bend) / (2 * bend)
                return {0: np.concatenate([-(w * y * _slope(m, bend)) @ z, ((z * inside[:, None]).T @ z).ravel()])}

            v = vector(summed(table, curvature), 0, (p + 1) * (p + 2))
            gradient = v[:p + 1] + ridge * now
            if np.abs(gradient).max() < 1e-7:
                break
            hessian = v[p + 1:].reshape(p + 1, p + 1) + np.diag(ridge)
            steps = [-np.linalg.solve(hessian + d * np.eye(p + 1), gradient) for d in DAMPINGS]
            tries = np.array([now + t * step for step in steps for t in LENGTHS])

            def values(pdf: pd.DataFrame, tries=tries, bend=bend) -> dict:
                z, y, w = scaled(pdf)
                return {0: np.array([w @ _smooth(y * (z @ b), bend) for b in tries])}

            loss = vector(summed(table, values), 0, len(tries)) + (tries ** 2 @ ridge) / 2
            new = tries[int(np.argmin(loss))]
            if np.abs(new - now).max() < 1e-9:
                break
            now = new

    def multipliers(pdf: pd.DataFrame) -> dict:
        z, y, w = scaled(pdf)
        a = w * _slope(y * (z @ now), BENDS[-1])
        return {k: np.concatenate([[a[y == s].sum()], a[y == s] @ z[y == s][:, 1:]]) for k, s in enumerate((-1, 1))}

    found = summed(table, multipliers)
    low, high = (vector(found, k, p + 1) for k in (0, 1))
    # the multipliers of both classes must add up to the same; the larger ones are made smaller, which keeps them feasible
    even = min(low[0], high[0])
    low, high = (side * (even / side[0]) if side[0] > 0 else side * 0 for side in (low, high))
    pull = high[1:] - low[1:]
    dual = low[0] + high[0] - pull @ pull / (2 * penalty)

    own = np.concatenate([[intercept], coefs * scale])

    def hinge(pdf: pd.DataFrame) -> dict:
        z, y, w = scaled(pdf)
        return {0: np.array([w @ np.maximum(0.0, 1 - y * (z @ b)) for b in (own, now)])}

    loss = vector(summed(table, hinge), 0, 2)
    primal, polished = (float(h + penalty / 2 * b[1:] @ b[1:]) for h, b in zip(loss, (own, now)))
    return Gap(primal, float(dual), polished, now[1:] / scale, float(now[0]))


def svm_gap(rows: DataFrame, fit: SvmFit, penalty: float = 0.1) -> Gap:
    """The gap of a machine fitted on balanced ``rows``."""
    if fit.linear:
        coefs, intercept = np.array([fit.linear.coefs[f] for f in fit.features]), fit.linear.intercept
    else:
        coefs, intercept = np.array(fit.machine.coefficients.toArray()), float(fit.machine.intercept)
    return duality_gap(machine_table(rows, fit), coefs, intercept, penalty)
