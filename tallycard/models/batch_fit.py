"""Many logistic fits over the same pattern table, one Spark job per Newton step.

Each task sums the gradient and curvature of every fit over its patterns; the
sums are added up by Spark, and only those (fits x features^2 numbers) reach
the driver. The cost does not depend on the number of records. With a
continuous feature the rows are the records themselves, each with n = 1.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard.models.linear import LinearFit


@dataclass(frozen=True)
class FitSpec:
    """One fit: its features, ridge strength, and the fold left out (None: use all rows).

    ``only``: a boolean column; other rows are not used. ``events``: the column of events. ``complete``: rows that miss
    a feature of this fit are not used, whatever other fits need.
    """

    name: str
    features: tuple[str, ...]
    penalty: float = 0.0
    leave_out: int | None = None
    only: str | None = None
    events: str = "pos"
    complete: bool = False


def _matrix(pdf: pd.DataFrame, features: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *[pdf[f].to_numpy(dtype=float) for f in features]])


def summed(pats: DataFrame, part) -> dict[tuple[int, int], float]:
    """Add up ``part(pdf) -> {fit number: vector}`` over all patterns.

    One row per partition, fit and slot is shuffled, whatever the data size.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in part(pdf).items():
                total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            yield pd.DataFrame({"fit": k, "slot": np.arange(len(v)), "value": v})

    added = pats.mapInPandas(sums, "fit int, slot int, value double").groupBy("fit", "slot").agg(
        F.sum("value").alias("value"))
    return {(r["fit"], r["slot"]): r["value"] for r in added.collect()}


def _vectors(found: dict[tuple[int, int], float], widths: list[int]) -> list[np.ndarray]:
    return [np.array([found.get((k, s), 0.0) for s in range(w)]) for k, w in enumerate(widths)]


def fit_many(pats: DataFrame, specs: list[FitSpec], steps: int = 60, tolerance: float = 1e-9) -> dict[str, LinearFit]:
    """Fit every spec by Newton steps.

    ``pats``: features, pos, n and, where a spec leaves a fold out, fold. The
    objective is mean log loss + penalty/2 * sum((sd * coef)^2), intercept free.
    Fits that ``steps`` steps leave open are named in a warning: a feature that
    separates the classes has no finite optimum.
    """
    def used(pdf: pd.DataFrame, spec: FitSpec) -> pd.DataFrame:
        if spec.leave_out is not None:
            pdf = pdf[pdf["fold"] != spec.leave_out]
        if spec.only is not None:
            pdf = pdf[pdf[spec.only].fillna(False).astype(bool)]
        return pdf.dropna(subset=list(spec.features)) if spec.complete else pdf

    def moments(pdf):
        out = {}
        for k, s in enumerate(specs):
            d = used(pdf, s)
            x, n = _matrix(d, s.features)[:, 1:], d["n"].to_numpy(dtype=float)
            out[k] = np.concatenate([[n.sum(), d[s.events].sum()], n @ x, n @ (x * x)])
        return out

    dims = [len(s.features) for s in specs]
    base = _vectors(summed(pats, moments), [2 + 2 * p for p in dims])
    size = [v[0] for v in base]
    spread, coefs = [], []
    for v, p in zip(base, dims):
        mean = v[2:2 + p] / v[0]
        spread.append(np.maximum(v[2 + p:] / v[0] - mean**2, 0.0) * v[0] / max(v[0] - 1, 1))
        rate = min(max(v[1] / v[0], 1e-9), 1 - 1e-9)
        coefs.append(np.concatenate([[np.log(rate / (1 - rate))], np.zeros(p)]))

    open_fits = set(range(len(specs)))
    for _ in range(steps):
        if not open_fits:
            break
        now, todo = coefs, sorted(open_fits)

        def curvature(pdf):
            out = {}
            for k in todo:
                d = used(pdf, specs[k])
                x, n = _matrix(d, specs[k].features), d["n"].to_numpy(dtype=float)
                p = 1 / (1 + np.exp(-np.clip(x @ now[k], -35, 35)))
                gradient = x.T @ (d[specs[k].events].to_numpy(dtype=float) - n * p)
                out[k] = np.concatenate([gradient, ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])
            return out

        found = summed(pats, curvature)
        step_to = list(coefs)
        for k in todo:
            w = dims[k] + 1
            v = np.array([found.get((k, s), 0.0) for s in range(w + w * w)])
            ridge = np.concatenate([[0.0], size[k] * specs[k].penalty * spread[k]])
            gradient = v[:w] - ridge * coefs[k]
            # the tiny diagonal keeps constant or perfectly separating features solvable
            hessian = v[w:].reshape(w, w) + np.diag(ridge + 1e-8 * max(size[k], 1.0))
            move = np.clip(np.linalg.solve(hessian, gradient), -4.0, 4.0)
            step_to[k] = coefs[k] + move
            if np.abs(move).max() < tolerance:
                open_fits.discard(k)
        coefs = step_to
    if open_fits:
        warnings.warn(f"not converged after {steps} steps: {', '.join(specs[k].name for k in sorted(open_fits))}", stacklevel=2)
    return {
        s.name: LinearFit(float(c[0]), dict(zip(s.features, map(float, c[1:])))) for s, c in zip(specs, coefs)
    }


def losses(pats: DataFrame, fits: dict[str, LinearFit]) -> dict[str, float]:
    """Total log loss of each fit over the pattern table, all in one job."""
    names = list(fits)

    def part(pdf):
        pos, n = pdf["pos"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
        out = {}
        for k, name in enumerate(names):
            f = fits[name]
            eta = _matrix(pdf, tuple(f.coefs)) @ np.array([f.intercept, *f.coefs.values()])
            out[k] = np.array([np.sum(n * np.logaddexp(0, eta) - pos * eta)])
        return out

    found = summed(pats, part)
    return {name: found.get((k, 0), float("nan")) for k, name in enumerate(names)}


def matrix_losses(pats: DataFrame, features: list[str], weights: np.ndarray, at_once: int = 20_000) -> np.ndarray:
    """Total log loss of every row of ``weights``: an intercept and a coefficient per feature.

    For thousands of candidates: a matrix product per slice of patterns, one number per task and candidate shuffled.
    """
    found = []
    for start in range(0, len(weights), at_once):
        shared = pats.sparkSession.sparkContext.broadcast(weights[start:start + at_once])

        def part(pdf, shared=shared):
            total = np.zeros(len(shared.value))
            x, pos, n = _matrix(pdf, tuple(features)), pdf["pos"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
            wide = max(1, 2_000_000 // max(len(shared.value), 1))
            for k in range(0, len(x), wide):
                eta = x[k:k + wide] @ shared.value.T
                total += n[k:k + wide] @ np.logaddexp(0, eta) - pos[k:k + wide] @ eta
            return {0: total}

        sums = summed(pats, part)
        found += [sums.get((0, k), 0.0) for k in range(len(shared.value))]
    return np.array(found)
