"""Neighbours by a grid of blocks against all pairs, with many features and small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycard.models import knn

WIDTH = 70
NAMES = [f"f{k}" for k in range(WIDTH)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    density = rng.choice([0.1, 0.3, 0.5], 400)
    bits = (rng.random((400, WIDTH)) < density[:, None]).astype(int)
    bits[300:] = bits[:100]  # frequent patterns
    bits[300:, 0] ^= 1
    fold, n = rng.integers(1, 4, 400), rng.integers(1, 6, 400)
    pos = rng.integers(0, n + 1)
    rows = [(*map(int, b), int(f), int(m), int(e)) for b, f, m, e in zip(bits, fold, n, pos)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in [*NAMES, "fold", "n", "pos"])).cache()
    return df, bits, fold, n, pos


def brute(bits, asked, fold, n, pos):
    out = {}
    for a in {tuple(r) for r in asked}:
        d = (bits != np.array(a)).sum(1)
        for k in range(len(bits)):
            key = (int(fold[k]), "".join(map(str, a)), int(d[k]))
            was = out.get(key, (0, 0))
            out[key] = (was[0] + int(n[k]), was[1] + int(pos[k]))
    return out


def collected(df):
    return {(r["fold"], r["code"], r["distance"]): (r["n"], r["pos"]) for r in df.collect()}


@pytest.mark.parametrize("sizes", [(4096, 16384, 256), (16, 32, 0)])
def test_all_shells(table, sizes):
    df, bits, fold, n, pos = table
    asked = df.limit(120)
    want = brute(bits, np.array(asked.select(*NAMES).collect()), fold, n, pos)
    assert collected(knn.shells(df, NAMES, ["fold"], wanted=asked, asked_block=sizes[0], train_block=sizes[1], few_cells=sizes[2])) == want


@pytest.mark.parametrize("kernel", ["rectangular", "triangular"])
@pytest.mark.parametrize("k", [1, 15, 5000])
def test_patterns_drop_out_once_they_have_enough(table, k, kernel):
    df, *_ = table
    plain = df.groupBy(*NAMES).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    every = knn.neighbour_share(knn.shells(plain, NAMES), F.lit(k), kernel)
    some = knn.shells(plain, NAMES, enough=k + 1, asked_block=16, train_block=32, few_cells=0)
    share = {r["code"]: round(r["p_event"], 9) for r in knn.neighbour_share(some, F.lit(k), kernel).collect()}
    assert share == {r["code"]: round(r["p_event"], 9) for r in every.collect()}
    if k == 1:
        assert some.count() < knn.shells(plain, NAMES).count() / 2


def test_leaving_out_a_fold_with_enough(table):
    df, *_ = table
    every = knn.without_fold(knn.shells(df, NAMES, ["fold"]), 3)
    some = knn.without_fold(knn.shells(df, NAMES, ["fold"], enough=26, asked_block=16, train_block=32, few_cells=0), 3)
    shares = [{(r["fold"], r["code"]): round(r["p_event"], 9) for r in knn.neighbour_share(x, F.lit(25), "triangular", ["fold"]).collect()} for x in (every, some)]
    assert shares[0] == shares[1]


def test_nothing_asked_and_nothing_to_learn_from(table):
    df, *_ = table
    none = df.limit(0)
    assert knn.shells(df, NAMES, wanted=none, enough=3).count() == 0
    assert knn.shells(none, NAMES, wanted=df, enough=3).count() == 0
