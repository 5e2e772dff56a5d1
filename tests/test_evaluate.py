import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallycard.operators import evaluate as ev


def table(seed=5, n=400, ties=True):
    rng = np.random.default_rng(seed)
    event = rng.random(n) < 0.3
    score = rng.normal(0, 1, n) + event
    return pd.DataFrame({"m": rng.choice(["p", "q"], n), "is_event": event, "score": np.round(score, 0 if ties else 9)})


def pairwise(pdf):
    pos, neg = pdf[pdf.is_event].score.to_numpy(), pdf[~pdf.is_event].score.to_numpy()
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + (d == 0).sum() / 2) / d.size


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("wide", [True, False])
def test_area_equals_pairwise_comparison(spark, ties, wide):
    pdf = table(ties=ties)
    got = {r.m: r.roc_auc for r in ev.roc_auc(spark.createDataFrame(pdf), ["m"], wide=wide).collect()}
    for m, part in pdf.groupby("m"):
        assert got[m] == pytest.approx(pairwise(part))


@given(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), min_size=1, max_size=30))
@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
def test_curve_is_monotone_and_closed(spark, rows):
    df = spark.createDataFrame(rows, "score int, is_event boolean")
    curve = ev.roc_curve(df, []).toPandas()
    points = curve[curve.point_kind == "score"].sort_values("score")
    events = sum(e for _, e in rows)
    ends = curve[curve.point_kind != "score"].set_index("point_kind")
    assert tuple(ends.loc["low_end"][["sensitivity", "specificity"]]) == (1.0, 0.0)
    assert tuple(ends.loc["high_end"][["sensitivity", "specificity"]]) == (0.0, 1.0)
    if events:
        assert points.sensitivity.is_monotonic_decreasing and points.sensitivity.iloc[0] == 1.0
    else:
        assert points.sensitivity.isna().all()
    if events < len(rows):
        assert points.specificity.is_monotonic_increasing and points.specificity.iloc[0] == 0.0


def test_empty_quadrants_give_missing_rates(spark):
    df = spark.createDataFrame([(True, False), (True, False)], "s boolean, e boolean")
    row = ev.screen_performance(df, F.col("s"), F.col("e")).first()
    assert (row.tp, row.tn, row.fp, row.fn) == (0, 0, 2, 0)
    assert (row.sensitivity, row.specificity, row.precision) == (None, 0.0, 0.0)


def test_precision_recall_area(spark):
    pdf = table(seed=9)
    df = spark.createDataFrame(pdf)
    for m, part in pdf.groupby("m"):
        x, y, area = 0.0, 1.0, 0.0
        for t in sorted(part.score.unique(), reverse=True):
            hit = part[part.score >= t]
            r, p = hit.is_event.sum() / part.is_event.sum(), hit.is_event.mean()
            area, x, y = area + (r - x) * (p + y) / 2, r, p
        for wide in (True, False):
            got = {r.m: r.pr_auc for r in ev.pr_auc(df, ["m"], wide=wide).collect()}
            assert got[m] == pytest.approx(area)


def test_metric_table(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300), 2)
    e = rng.random(300) < p
    pdf = pd.DataFrame({"k": "one", "p_event": p, "is_event": e, "pred_class": np.where(p >= 0.5, "Abnormal", "Normal")})
    got = {}
    for discrete in (True, False):
        rows = ev.metric_table(spark.createDataFrame(pdf), ["k"], discrete=discrete).collect()
        got[discrete] = {r.metric: r.estimate for r in rows}
    call = p >= 0.5
    agree = (call == e).mean()
    chance = call.mean() * e.mean() + (1 - call.mean()) * (1 - e.mean())
    clip = np.clip(p, 2.2e-16, 1 - 2.2e-16)
    want = {
        "accuracy": agree, "kap": (agree - chance) / (1 - chance),
        "mn_log_loss": -np.mean(np.where(e, np.log(clip), np.log(1 - clip))),
        "roc_auc": pairwise(pdf.rename(columns={"p_event": "score"})),
    }
    assert got[True] == pytest.approx(want) and got[False] == pytest.approx(want)
    pats = pdf.groupby(["k", "p_event", "pred_class"]).agg(pos=("is_event", "sum"), n=("is_event", "size")).reset_index()
    counted = ev.metric_table(spark.createDataFrame(pats), ["k"], discrete=True, counted=True).collect()
    assert {r.metric: r.estimate for r in counted} == pytest.approx(want)


def test_ties_are_kept_or_cut_by_preference(spark):
    m = spark.createDataFrame(
        [("a", 1, 0.1 + 0.2), ("a", 2, 0.3), ("a", 3, 0.1), ("b", None, 0.5)], "model string, terms int, mean double")
    assert {(r.model, r.terms) for r in ev.best_settings(m, ["model"]).collect()} == {("a", 1), ("a", 2), ("b", None)}
    cut = ev.best_settings(m, ["model"], [F.col("terms").asc_nulls_last()]).collect()
    assert {(r.model, r.terms) for r in cut} == {("a", 1), ("b", None)}


def test_replicates_group_missing_settings_together(spark):
    m = spark.createDataFrame([("x", None, 1, 0.2), ("x", None, 2, 0.4), ("y", 3, 1, 0.5)], "model string, penalty int, fold int, estimate double")
    rows = {r.model: r for r in ev.mean_interval(m, ["fold"]).collect()}
    assert rows["x"].mean == pytest.approx(0.3) and rows["x"].n == 2 and rows["x"].se == pytest.approx(0.1)
    assert rows["y"].sd is None
