"""Association among yes/no and ordered predictors.

Everything starts from the contingency tables of all column pairs, which one
pass over the patterns gives. What follows works on those small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycard.functions.values import ratio


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """bin for yes/no, ter for ordered categories, con for numbers; with rows known."""
    kinds = {"boolean": "bin", "string": "ter"}
    types = dict(df.dtypes)
    known = df.agg(*[F.count(c).alias(c) for c in columns])
    return known.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kinds.get(types[c], "con")).alias("type"), F.col(c).alias("n_known"))
        for c in columns
    ])))


def pair_tables(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of (vi, vj) for every pair of integer-coded columns, complete cases only.

    Rows are first counted per combination of all columns, so the pairs are
    formed from those few rows and not from the records.
    """
    pats = df.select(*columns).dropna().groupBy(*columns).agg(F.count("*").alias("n"))
    pairs = [
        F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(a).cast("int").alias("vi"), F.col(b).cast("int").alias("vj"))
        for x, a in enumerate(columns) for b in columns[x + 1:]
    ]
    return pats.select("n", F.inline(F.array(*pairs))).groupBy("i", "j", "vi", "vj").agg(F.sum("n").alias("n"))


def pair_cells(tables: DataFrame, most: int = 10_000) -> DataFrame:
    """One row per pair with its table as an array: at most levels x levels cells.

    More than ``most`` cells are an error: such columns are no categories, and
    the coefficients compare cells pairwise.
    """
    sizes = tables.groupBy("i", "j").agg(F.count("*").alias("cells")).agg(F.max("cells")).first()[0]
    if sizes and sizes > most:
        raise ValueError(f"a pair of columns has {sizes} cells, more than {most}; rank_assoc.tau_pairs takes numbers")
    cell = F.struct(F.col("vi"), F.col("vj"), F.col("n").cast("double").alias("n"))
    return tables.groupBy("i", "j").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def _total(cells, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + value(c))


def kendall_phi(tables: DataFrame) -> DataFrame:
    """Kendall's tau-a and tau-b and the product-moment (phi) coefficient of every pair."""
    cells = F.col("cells")
    beside = lambda c, test: _total(F.filter(cells, lambda d: test(c, d)), lambda d: d["n"])
    concordant = _total(cells, lambda c: c["n"] * beside(c, lambda c, d: (d["vi"] < c["vi"]) & (d["vj"] < c["vj"])))
    discordant = _total(cells, lambda c: c["n"] * beside(c, lambda c, d: (d["vi"] < c["vi"]) & (d["vj"] > c["vj"])))
    tied = lambda v: _total(cells, lambda c: c["n"] * (beside(c, lambda c, d: d[v] == c[v]) - 1) / 2)
    moment = lambda f: _total(cells, lambda c: c["n"] * f(c))
    sums = pair_cells(tables).select(
        "i", "j", _total(cells, lambda c: c["n"]).alias("n"), (concordant - discordant).alias("s"),
        tied("vi").alias("ti"), tied("vj").alias("tj"),
        moment(lambda c: c["vi"]).alias("x"), moment(lambda c: c["vj"]).alias("y"),
        moment(lambda c: c["vi"] * c["vi"]).alias("xx"), moment(lambda c: c["vj"] * c["vj"]).alias("yy"),
        moment(lambda c: c["vi"] * c["vj"]).alias("xy"))
    n = F.col("n")
    all_pairs = n * (n - 1) / 2
    spread = (n * F.col("xx") - F.col("x") ** 2) * (n * F.col("yy") - F.col("y") ** 2)
    return sums.select(
        "i", "j", n.cast("long").alias("n"), ratio(F.col("s"), all_pairs).alias("tau_a"),
        ratio(F.col("s"), F.sqrt((all_pairs - F.col("ti")) * (all_pairs - F.col("tj")))).alias("tau_b"),
        ratio(n * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread)).alias("phi"))


# ---- latent normal correlation ------------------------------------------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _phi(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + erf(v / sqrt(2))) for v in np.ravel(x)]).reshape(np.shape(x))


def _below(a: np.ndarray, b: np.ndarray, rho: float) -> np.ndarray:
    """P(X <= a, Y <= b) for standard normals with correlation rho; a, b finite grids.

    Integrated over the angle whose sine is the correlation, which is smooth up to -1 and 1.
    """
    top = np.arcsin(rho)
    angle = top * (_NODES + 1) / 2
    a, b = a[..., None], b[..., None]
    density = np.exp(-(a * a - 2 * np.sin(angle) * a * b + b * b) / (2 * np.cos(angle) ** 2)) / (2 * np.pi)
    return _phi(a[..., 0]) * _phi(b[..., 0]) + top / 2 * (density @ _WEIGHTS)


def _tau_of(rho: float, ti: np.ndarray, tj: np.ndarray) -> float:
    """Population tau-a of two normals cut at thresholds ti and tj."""
    inner = _below(np.repeat(ti[:, None], len(tj), 1), np.repeat(tj[None, :], len(ti), 0), rho)
    grid = np.zeros((len(ti) + 2, len(tj) + 2))
    grid[1:-1, 1:-1] = inner
    grid[-1, 1:-1], grid[1:-1, -1], grid[-1, -1] = _phi(tj), _phi(ti), 1.0
    p = np.diff(np.diff(grid, axis=0), axis=1)
    lower = grid[:-1, :-1]  # everything below and left of each cell
    right = grid[:-1, -1][:, None] - grid[:-1, 1:]  # below and to the right
    return float(2 * np.sum(p * (lower - right)))


def latent_from_cells(cells: list[tuple[int, int, float]]) -> tuple[float, float]:
    """Correlation of two latent normals that reproduces the table's tau-a, and the tau-a it implies.

    A tau-a beyond what two normals with these shares can have gives -1 or 1.
    """
    n = sum(c[2] for c in cells)
    cuts, axes = [], []
    for side in (0, 1):
        values = sorted({c[side] for c in cells})
        share = np.cumsum([sum(c[2] for c in cells if c[side] == v) for v in values]) / n
        if len(values) < 2:
            return float("nan"), float("nan")
        cuts.append(np.array([NormalDist().inv_cdf(min(max(s, 1e-9), 1 - 1e-9)) for s in share[:-1]]))
        axes.append({v: k for k, v in enumerate(values)})
    t = np.zeros((len(axes[0]), len(axes[1])))
    for vi, vj, m in cells:
        t[axes[0][vi], axes[1][vj]] = m / n
    lower = np.zeros_like(t)
    lower[1:, 1:] = np.cumsum(np.cumsum(t, 0), 1)[:-1, :-1]
    right = np.zeros_like(t)
    right[1:, :-1] = np.cumsum(np.cumsum(t, 0)[:, ::-1], 1)[:, ::-1][:-1, 1:]
    tau = 2 * float(np.sum(t * (lower - right))) * n / (n - 1)
    lo, hi = -1.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _tau_of(mid, *cuts) < tau else (lo, mid)
    return (lo + hi) / 2, _tau_of((lo + hi) / 2, *cuts)


def _tau_of_number(rho: float, cuts: np.ndarray, points: int = 2000) -> float:
    """Population tau-a of a normal and another one cut at ``cuts``, summed over quantiles of the first."""
    x = np.array([NormalDist().inv_cdf((k + 0.5) / points) for k in range(points)])
    inner = _phi((cuts[None, :] - rho * x[:, None]) / max(sqrt(1 - rho * rho), 1e-9))
    p = np.diff(np.concatenate([np.zeros((points, 1)), inner, np.ones((points, 1))], axis=1), axis=1)
    before = np.cumsum(p, axis=0) - p  # levels at smaller values of the first
    below = np.cumsum(before, axis=1) - before
    above = before.sum(axis=1, keepdims=True) - below - before
    return float(2 * np.sum(p * (below - above))) / points ** 2


def latent_rho_of_tau(tau: float, shares_i, shares_j) -> tuple[float, float]:
    """Correlation of two normals with this tau-a, and the tau-a it implies; shares of levels, or None for a number."""
    cut = lambda shares: np.array([NormalDist().inv_cdf(min(max(s, 1e-9), 1 - 1e-9)) for s in np.cumsum(shares)[:-1]])
    sides = [None if s is None else cut(s) for s in (shares_i, shares_j)]
    if tau is None or np.isnan(tau) or any(s is not None and not len(s) for s in sides):
        return float("nan"), float("nan")
    if sides[0] is None and sides[1] is None:
        return float(np.sin(np.pi * tau / 2)), float(tau)
    of = (lambda r: _tau_of(r, *sides)) if sides[0] is not None and sides[1] is not None else (
        lambda r: _tau_of_number(r, sides[0] if sides[1] is None else sides[1]))
    lo, hi = -1.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if of(mid) < tau else (lo, mid)
    return (lo + hi) / 2, of((lo + hi) / 2)


def latent_corr(tables: DataFrame) -> DataFrame:
    """Latent correlation ``rho`` of every pair and the tau-a it implies; the solver sees one small table at a time."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rho = [latent_from_cells([(c["vi"], c["vj"], c["n"]) for c in cells]) for cells in pdf["cells"]]
            yield pdf[["i", "j"]].assign(rho=[r for r, _ in rho], tau=[t for _, t in rho])

    return pair_cells(tables).mapInPandas(solve, "i string, j string, rho double, tau double")


def full_matrix(pairs: DataFrame, value: str) -> DataFrame:
    """Both triangles and the diagonal of a pairwise table."""
    rows = F.inline(F.array(
        F.struct(F.col("i").alias("row_item"), F.col("j").alias("column_item"), F.col(value).alias("value")),
        F.struct(F.col("j").alias("row_item"), F.col("i").alias("column_item"), F.col(value).alias("value")),
        F.struct(F.col("i").alias("row_item"), F.col("i").alias("column_item"), F.lit(1.0).alias("value")),
        F.struct(F.col("j").alias("row_item"), F.col("j").alias("column_item"), F.lit(1.0).alias("value")),
    ))
    return pairs.select(rows).dropDuplicates(["row_item", "column_item"])


def matrix_report(matrix: DataFrame, columns: list[str], labels: DataFrame, digits: int = 3) -> DataFrame:
    """Labelled matrix with rounded text cells."""
    wide = matrix.groupBy("row_item").pivot("column_item", columns).agg(F.first("value"))
    text = {c: F.format_string(f"%.{digits}f", F.round(c, digits)) for c in columns}
    return wide.withColumns(text).join(F.broadcast(labels), F.col("row_item") == F.col("item"), "left").select(
        "row_item", "label", *columns)


def matrix_eigen(matrix: DataFrame) -> DataFrame:
    """Eigenvalues and item coordinates (vector times root of the value) of a pairwise matrix.

    The matrix has one row per pair of predictors, whatever the number of records.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="row_item", columns="column_item", values="value").fillna(0.0)
        values, vectors = np.linalg.eigh(m.to_numpy())
        parts = []
        for k, at in enumerate(np.argsort(values)[::-1], 1):
            v = vectors[:, at]
            v = v * np.sign(v[np.argmax(np.abs(v))])
            parts.append(pd.DataFrame({
                "component": k, "eigenvalue": values[at], "item": list(m.index), "loading": v,
                "coordinate": v * np.sqrt(max(values[at], 0.0)),
            }))
        return pd.concat(parts)

    return matrix.groupBy().applyInPandas(
        solve, "component int, eigenvalue double, item string, loading double, coordinate double")
