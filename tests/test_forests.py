"""Forests grown together: the same trees for any partitioning, plain growth of one tree, and folds."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallycard.models import forests
from tallycard.plans.tuning import forest_cv

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    n = 900
    x = (rng.random((n, 4)) < [0.5, 0.3, 0.4, 0.6]).astype(int)
    p = 1 / (1 + np.exp(-(-1.2 + 1.5 * x[:, 0] - x[:, 1] + 2 * x[:, 2] * x[:, 3])))
    return pd.DataFrame(x, columns=NAMES).assign(record_id=np.arange(n), is_event=rng.random(n) < p, fold=rng.integers(1, 4, n))


def plain_tree(rows, family, tree, mtry, path=""):
    """path -> rows, events, feature of one tree, by recursion over the drawn records."""
    n, pos = int(rows.w.sum()), int((rows.w * rows.is_event).sum())
    draws = sorted((hashlib.md5(f"1|{family}|{tree}|{path}|{f}".encode()).hexdigest(), k) for k, f in enumerate(NAMES))[:mtry]
    best = None
    for _, k in draws:
        high = rows[rows[NAMES[k]] == 1]
        n1, pos1 = int(high.w.sum()), int((high.w * high.is_event).sum())
        if 0 < n1 < n and pos1 * (n - n1) != (pos - pos1) * n1:
            gain = pos1 * pos1 / n1 + (pos - pos1) ** 2 / (n - n1)
            if best is None or (gain, -k) > best:
                best = gain, -k
    out = {path: (n, pos, None if best is None else NAMES[-best[1]])}
    if best is not None:
        k = -best[1]
        for side, mark in ((0, "<"), (1, ">")):
            out |= plain_tree(rows[rows[NAMES[k]] == side], family, tree, mtry, f"{path}{k}{mark}")
    return out


def drawn(table, tree):
    digits = [hashlib.md5(f"1|{tree}|{i}".encode()).hexdigest()[:8] for i in table.record_id]
    return table.assign(w=[sum(d >= s for s in forests.STEPS) for d in digits])


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_match_plain_growth(spark, table, parts):
    df = spark.createDataFrame(table).repartition(parts)
    families = [forests.Family(1, 2, 1), forests.Family(2, 4, 2)]
    got = forests.grow_forests(df, NAMES, families, 3).nodes.collect()
    found = {(r["family"], r["tree"], r["path"]): (r["n"], r["pos"], r["feature"]) for r in got}
    assert len(found) == len(got)
    want = {}
    for f in families:
        for tree in (1, 2, 3):
            rows = drawn(table[table.fold != f.leave_out], tree)
            want |= {(f.number, tree, path): v for path, v in plain_tree(rows, f.number, tree, f.mtry).items() if v[0] or path == ""}
    # patterns that are only asked for may reach nodes that drew nothing
    assert {k: v for k, v in found.items() if v[0] or k[2] == ""} == want


def test_draws_are_poisson(spark):
    mean, square = spark.range(40_000).select(forests.draws(3, F.col("id")).alias("w")).agg(F.avg("w"), F.avg(F.col("w") * F.col("w"))).first()
    assert mean == pytest.approx(1, abs=0.02) and square == pytest.approx(2, abs=0.08)


def test_draws_are_compiled_and_match_the_sql_steps(spark):
    """The draw is the SQL's sum of (h >= step)::INT, without lambdas that Spark would run interpreted row by row."""
    df = spark.range(3000).select("id", forests.draws(3, F.col("id")).alias("w"))
    assert "lambdafunction" not in df._jdf.queryExecution().executedPlan().toString().lower()
    want = {i: sum(hashlib.md5(f"3|{i}".encode()).hexdigest()[:8] >= step for step in forests.STEPS) for i in range(3000)}
    assert {r["id"]: r["w"] for r in df.collect()} == want


def test_depth_and_least_rows(spark, table):
    df = spark.createDataFrame(table.drop(columns="fold"))
    shallow = forests.grow_forests(df, NAMES, [forests.Family(1, 4)], 2, depth=1, asked=df).nodes.collect()
    assert max(r["path"].count("<") + r["path"].count(">") for r in shallow) == 1
    nodes = forests.grow_forests(df, NAMES, [forests.Family(1, 4)], 2, least=100, asked=df).nodes.collect()
    assert all(r["n"] >= 200 for r in nodes if r["feature"]) and len(nodes) > 2


def test_no_bootstrap_and_all_features_give_each_pattern_its_share(spark, table):
    df = spark.createDataFrame(table.drop(columns="fold"))
    grown = forests.grow_forests(df, NAMES, [forests.Family(1, 4)], 2, bootstrap=False, asked=df)
    got = {r["code"]: r["p_event"] for r in forests.forest_shares(grown.leaves, [2]).collect()}
    want = table.groupby(NAMES).is_event.mean()
    assert set(got) == {"".join(map(str, k)) for k in want.index}
    # splitting ends only where no split changes the share
    assert np.mean([abs(got["".join(map(str, k))] - v) < 1e-12 for k, v in want.items()]) > 0.8


def test_cross_validated_grid(spark, table):
    got = forest_cv(spark.createDataFrame(table), NAMES, [1, 5], [1, 3], 3).toPandas()
    assert set(map(tuple, got[["trees", "mtry", "fold"]].drop_duplicates().to_numpy())) == {(t, m, k) for t in (1, 5) for m in (1, 3) for k in (1, 2, 3)}
    auc = got[got.metric == "roc_auc"]
    assert auc.estimate.mean() > 0.65


def test_no_rows(spark, table):
    none = spark.createDataFrame(table.drop(columns="fold")).limit(0)
    grown = forests.grow_forests(none, NAMES, [forests.Family(1, 2)], 2, asked=none)
    assert grown.nodes.count() == 0 and forests.forest_shares(grown.leaves, [2]).count() == 0
