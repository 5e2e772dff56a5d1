import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycard.operators import cards as ops
from tallycard.operators.evaluate import roc_points, threshold_totals


def coefs(spark, rows):
    return spark.createDataFrame(rows, "model string, item string, coef double")


def test_points_round_half_to_even_and_reach_the_bound(spark):
    df = coefs(spark, [("m", "a", -2.0), ("m", "b", 0.5), ("m", "c", 1.5), ("z", "a", 0.0)])
    got = {(r.model, r.item): r.points for r in ops.coef_to_points(df, ["model"], F.lit(2)).collect()}
    assert got == {("m", "a"): -2, ("m", "b"): 0, ("m", "c"): 2, ("z", "a"): None}
    rng = np.random.default_rng(0)
    many = coefs(spark, [("m", str(i), float(c)) for i, c in enumerate(rng.normal(0, 2, 30))])
    points = [r.points for r in ops.coef_to_points(many, ["model"], F.lit(25)).collect()]
    assert max(map(abs, points)) == 25


def test_score_range_and_monotone_risk(spark):
    pts = spark.createDataFrame([("m", "a", -2), ("m", "b", 3)], "model string, item string, points int")
    s = ops.score_range(pts, ["model"])
    assert sorted(r.score for r in s.collect()) == list(range(-2, 4))
    risk = [r[0] for r in s.orderBy("score").select(ops.risk_of(F.col("score"), F.lit(-1.0), F.lit(2.0))).collect()]
    assert risk == sorted(risk) and risk[2] == pytest.approx(1 / (1 + np.exp(0.5)))
    scaled = s.filter("score = 2").select(ops.risk_of(F.col("score"), F.lit(-1.0), scale=F.lit(0.25))).first()[0]
    assert scaled == pytest.approx(1 / (1 + np.exp(0.5)))


def test_scores_keep_missing_items_missing(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, True)], "id int, a boolean, b boolean")
    got = {(r.id, r.card): r.score for r in ops.score_records(df, {"x": (0, 1, {"a": 2, "b": 5}), "y": (0, 1, {"a": 1, "b": 0})}, ["id"]).collect()}
    assert got == {(1, "x"): None, (2, "x"): 5, (1, "y"): 1, (2, "y"): 0}


def roc(spark):
    rows = [("k", s, e) for s, e in [(0, False)] * 6 + [(1, False)] * 2 + [(1, True)] + [(2, False)] * 2 + [(2, True)] * 3]
    return roc_points(threshold_totals(spark.createDataFrame(rows, "card string, score int, is_event boolean"), ["card"]), ["card"])


def test_cutoffs(spark):
    r = roc(spark)  # specificity 0, .6, .8
    assert ops.anchored_cutoffs(r, ["card"], F.lit(0.75), 0.05).first().score == 2
    assert ops.anchored_cutoffs(r, ["card"], F.lit(0.85), 0.05).count() == 1
    assert ops.anchored_cutoffs(r, ["card"], F.lit(0.9), 0.05).count() == 0
    tie = ops.anchored_cutoffs(r, ["card"], F.lit(0.7), 0.5)
    assert tie.first().score in (1, 2)
    sides = {x.side: x.score for x in ops.two_sided_cutoffs(r, ["card"], F.lit(0.7)).collect()}
    assert sides == {-1: 1, 1: 2}
    exact = r.filter("score = 1").select("specificity").first()[0]
    assert {x.side: x.score for x in ops.two_sided_cutoffs(r, ["card"], F.lit(exact)).collect()} == {-1: 0, 0: 1, 1: 2}


def test_risk_crossing(spark):
    sr = spark.createDataFrame([("k", s, s / 10) for s in range(5)], "card string, score int, risk double")
    assert [x.score for x in ops.risk_to_score(sr, ["card"], F.lit(0.25)).collect()] == [3]
    assert ops.risk_to_score(sr, ["card"], F.lit(0.9)).count() == 0


def test_screens_and_patterns(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0)], "id int, a int, b int")
    cards = {"x": (0.0, 1.0, {"a": 1}), "y": (0.0, 1.0, {"b": 1})}
    screens = ops.screen_columns(df, cards, {"x": 1, "y": 1, "y@0": 0}, ["id"])
    assert {(r.id, r.x, r.y, r["y@0"]) for r in screens.collect()} == {(1, "Y", "N", "Y"), (2, "Y", "Y", "Y"), (3, "N", "N", "Y")}
    counted = ops.pattern_counts(screens, ["x", "y"])
    assert {(r.pattern, r.n) for r in counted.collect()} == {("Y_N", 1), ("Y_Y", 1), ("N_N", 1)}
    assert ops.pattern_flows(counted, ["x", "y"]).filter("tool = 'x' AND screen = 'Y'").count() == 2


def test_points_matrix_drops_unused_items(spark):
    pts = spark.createDataFrame([("m", "a", -4), ("n", "a", 1), ("m", "b", 0), ("n", "b", 0), ("n", "c", 2)], "model string, item string, points int")
    used = ops.used_items(pts).orderBy("place").collect()
    assert [(r["item"], r.largest) for r in used] == [("a", 4), ("c", 2)]
    wide = {r.model: (r.a, r.c) for r in ops.points_matrix(pts, ["model"], ["a", "c"]).collect()}
    assert wide == {"m": (-4, None), "n": (1, 2)}


def test_cards_from_points_roundtrip(spark):
    pts = spark.createDataFrame([("m", -3.0, 2.0, "a", 1), ("m", -3.0, 2.0, "b", -1)], "card string, intercept double, multiplier double, item string, points int")
    assert ops.cards_from_points(pts, "card") == {"m": (-3.0, 2.0, {"a": 1, "b": -1})}
