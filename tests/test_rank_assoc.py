"""Rank correlation against plain pair counting."""

import numpy as np
import pytest

from tallycard.operators import assoc, rank_assoc


def brute(x, y, w):
    return sum(w[a] * w[b] * np.sign(x[a] - x[b]) * np.sign(y[a] - y[b]) for a in range(len(x)) for b in range(a))


@pytest.mark.parametrize("levels", [1, 2, 5, 1000])
def test_signed_pairs(levels):
    rng = np.random.default_rng(levels)
    for n in (0, 1, 2, 3, 60):
        x, y, w = rng.integers(0, levels, n).astype(float), rng.integers(0, 7, n).astype(float), rng.integers(1, 4, n).astype(float)
        assert rank_assoc.signed_pairs(x, y, w) == brute(x, y, w)


# many ranges; ranges of ranges; everything in one
@pytest.mark.parametrize("sizes", [(20, 4, 8), (50, 32, 512), (1_000_000, 32, 512)])
def test_tau_of_hot_and_continuous_columns(spark, sizes):
    rng = np.random.default_rng(3)
    n = 600
    a = rng.normal(size=n)
    hot = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n) + a)  # two fifths of the rows share a value
    code = np.digitize(a + rng.normal(size=n), [-0.5, 0.7])
    flat = np.ones(n)
    rows = [tuple(map(float, r)) for r in zip(a, hot, code, flat)] + [(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, hot double, code double, flat double")
    got = {(r["i"], r["j"]): r for r in rank_assoc.tau_pairs(df, ["a", "hot", "code", "flat"], *sizes).collect()}
    data = {"a": a, "hot": hot, "code": code.astype(float), "flat": flat}
    assert len(got) == 6
    for (i, j), r in got.items():
        x, y = data[i], data[j]
        s = np.sum(np.sign(x[:, None] - x) * np.sign(y[:, None] - y)) / 2
        ties = lambda v: sum(m * (m - 1) / 2 for m in np.unique(v, return_counts=True)[1])
        every = n * (n - 1) / 2
        assert r["n"] == n and r["tau_a"] == pytest.approx(s / every, abs=1e-12)
        if j == "flat":
            assert r["tau_b"] is None and r["phi"] is None
        else:
            assert r["tau_b"] == pytest.approx(s / np.sqrt((every - ties(x)) * (every - ties(y))), abs=1e-12)
            assert r["phi"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_tau_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    r = rank_assoc.tau_pairs(df, ["a", "b"]).first()
    assert r["n"] == 0 and r["tau_a"] is None


def test_latent_correlation_with_numbers(spark):
    rng = np.random.default_rng(8)
    n, rho = 40_000, 0.6
    z = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
    rows = [(float(np.exp(x)), float(y), int(y > 0.8), int(np.digitize(x, [-1.0, 0.5]))) for x, y in z]
    got = {(r["i"], r["j"]): r["rho"] for r in rank_assoc.latent_mixed(spark.createDataFrame(rows, "x double, y double, yes int, ter int"), ["x", "y", "yes", "ter"]).collect()}
    assert got["x", "y"] == pytest.approx(rho, abs=0.02)
    assert got["x", "yes"] == pytest.approx(rho, abs=0.03)
    assert got["y", "ter"] == pytest.approx(rho, abs=0.03)
    assert got["yes", "ter"] == pytest.approx(rho, abs=0.04)


def test_tau_with_a_number_is_the_known_one():
    # one cut: 4 P(X < 0, Y < c; rho / sqrt 2) - 2 P(Y < c)
    for rho, c in ((0.5, 0.3), (-0.8, 1.0)):
        known = 4 * float(assoc._below(np.array([c]), np.array([0.0]), rho / np.sqrt(2))[0]) - 2 * float(assoc._phi(np.array([c]))[0])
        assert abs(assoc._tau_of_number(rho, np.array([c]))) == pytest.approx(abs(known), abs=1e-5)
