"""Confusion tables, curves, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.values import class_label, if_else
from tallycard.operators.asof import asof_match, nearest
from tallycard.operators.cards import score_records
from tallycard.operators.evaluate import (
    auc, confusion_counts, metric_table, nearest_either_side, pr_auc, pr_curve, roc_auc, roc_curve,
    roc_points, screen_performance, threshold_totals,
)
from tallycard.registry.base import query, r6
from tallycard.session import settled
from tallycard.sources.fixtures import CARDS, DOCS_SQL, SCORED_SQL, STUDY_SQL, doc_scores, study, table

RATES = ["sensitivity", "specificity", "precision", "recall"]


@query("screen_performance", f"""
WITH {STUDY_SQL}, q AS (
  SELECT sum((guideline AND is_event)::INT)::BIGINT AS tp, sum((NOT guideline AND NOT is_event)::INT)::BIGINT AS tn,
         sum((guideline AND NOT is_event)::INT)::BIGINT AS fp, sum((NOT guideline AND is_event)::INT)::BIGINT AS fn FROM study)
SELECT *, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity,
  round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM q""")
def guideline_performance(spark, sf):
    perf = screen_performance(study(spark, sf), F.col("guideline"), F.col("is_event"))
    return perf.withColumns({c: r6(c) for c in RATES})


CALLED_SQL = SCORED_SQL + """,
called AS (
  SELECT card, record_id, is_event, 1 / (1 + exp(-(intercept + score) / multiplier)) AS p,
         CASE WHEN score >= 3 THEN 'Abnormal' ELSE 'Normal' END AS pred_class,
         CASE WHEN is_event THEN 'Abnormal' ELSE 'Normal' END AS truth, score
  FROM scored)"""


def called(spark, sf, keep=("record_id", "is_event")):
    """Predictions of all cards: probability and class (score of at least 3)."""
    scored = score_records(study(spark, sf), CARDS, list(keep))
    return scored.withColumns({
        "pred_class": if_else(F.col("score") >= 3, F.lit("Abnormal"), F.lit("Normal")),
        "truth": class_label(F.col("is_event")),
    })


@query("confusion_counts", f"WITH {CALLED_SQL} SELECT card, pred_class, truth, count(*) AS n FROM called GROUP BY ALL")
def confusions(spark, sf):
    return confusion_counts(called(spark, sf), ["card"])


ROC_SQL = SCORED_SQL + """,
counts AS (SELECT card, score, sum(is_event::INT) AS pos, sum(1 - is_event::INT) AS neg FROM scored GROUP BY ALL),
totals AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY card) AS p, sum(neg) OVER (PARTITION BY card) AS q
  FROM counts WINDOW w AS (PARTITION BY card ORDER BY score DESC)),
roc AS (SELECT card, score, tp::DOUBLE / p::DOUBLE AS sensitivity, 1 - fp::DOUBLE / q::DOUBLE AS specificity FROM totals)"""

DOC_ROC_SQL = DOCS_SQL + """,
counts AS (SELECT model, score, sum(is_event::INT) AS pos, sum(1 - is_event::INT) AS neg FROM preds GROUP BY ALL),
totals AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS q
  FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
roc AS (SELECT model, score, tp::DOUBLE / nullif(p, 0)::DOUBLE AS sensitivity, 1 - fp::DOUBLE / nullif(q, 0)::DOUBLE AS specificity FROM totals)"""


def card_totals(s):
    """Counts per card and score, written once: the queries below use them several times."""
    return settled(threshold_totals(score_records(s, CARDS, ["is_event"]), ["card"]))


def roc_of(s):
    return roc_points(card_totals(s), ["card"])


@query("roc_curve", f"""
WITH {DOC_ROC_SQL}
SELECT model, score, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, 'score' AS point_kind FROM roc
UNION ALL SELECT DISTINCT model, NULL::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 'low_end' FROM preds
UNION ALL SELECT DISTINCT model, NULL::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, 'high_end' FROM preds""")
def document_roc(spark, sf):
    """Scores with few ties, any number of thresholds per model."""
    curve = roc_curve(doc_scores(spark, sf), ["model"], wide=True)
    return curve.withColumns({c: r6(c) for c in ("sensitivity", "specificity")})


@query("roc_curve_cards", f"""
WITH {ROC_SQL}
SELECT card, score, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, 'score' AS point_kind FROM roc
UNION ALL SELECT DISTINCT card, NULL::INT, 1.0::DOUBLE, 0.0::DOUBLE, 'low_end' FROM scored
UNION ALL SELECT DISTINCT card, NULL::INT, 0.0::DOUBLE, 1.0::DOUBLE, 'high_end' FROM scored""")
def card_roc_curve(spark, sf):
    curve = roc_curve(score_records(study(spark, sf), CARDS, ["is_event"]), ["card"])
    return curve.withColumns({c: r6(c) for c in ("sensitivity", "specificity")})


@query("pr_curve", f"""
WITH {DOC_ROC_SQL}
SELECT model, score, round(tp::DOUBLE / nullif(p, 0)::DOUBLE, 6) AS recall, round(tp::DOUBLE / (tp + fp)::DOUBLE, 6) AS precision, 'score' AS point_kind FROM totals
UNION ALL SELECT DISTINCT model, NULL::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, 'start' FROM preds""")
def document_pr(spark, sf):
    curve = pr_curve(doc_scores(spark, sf), ["model"], wide=True)
    return curve.withColumns({c: r6(c) for c in ("recall", "precision")})


@query("roc_auc", f"""
WITH {DOC_ROC_SQL}
SELECT model, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6) AS roc_auc FROM totals GROUP BY model""")
def document_auc(spark, sf):
    return roc_auc(doc_scores(spark, sf), ["model"], wide=True).withColumn("roc_auc", r6("roc_auc"))


@query("pr_auc", f"""
WITH {DOC_ROC_SQL}, c AS (
  SELECT model, score, tp::DOUBLE / nullif(p, 0)::DOUBLE AS recall, tp::DOUBLE / (tp + fp)::DOUBLE AS precision FROM totals),
s AS (SELECT model, recall, precision, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, 1) AS p0 FROM c WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM s GROUP BY model""")
def document_pr_auc(spark, sf):
    return pr_auc(doc_scores(spark, sf), ["model"], wide=True).withColumn("pr_auc", r6("pr_auc"))


@query("metrics_long", f"""
WITH {CALLED_SQL}, f AS (
  SELECT card, count(*)::DOUBLE AS n, sum((truth = pred_class)::INT)::DOUBLE AS agree, sum((pred_class = 'Abnormal')::INT)::DOUBLE AS c,
         sum(is_event::INT)::DOUBLE AS e, -avg(CASE WHEN is_event THEN ln(p) ELSE ln(1 - p) END) AS mn_log_loss FROM called GROUP BY card),
k AS (SELECT *, (c * e + (n - c) * (n - e)) / (n * n) AS chance, agree / n AS observed FROM f),
counts AS (SELECT card, score, sum(is_event::INT) AS pos, sum(1 - is_event::INT) AS neg FROM called GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER (PARTITION BY card ORDER BY score DESC) - pos AS above FROM counts),
a AS (SELECT card, sum(neg * (above + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc FROM t GROUP BY card),
w AS (SELECT card, unnest(['accuracy', 'kap', 'mn_log_loss', 'roc_auc']) AS metric,
  unnest([observed, (observed - chance) / (1 - chance), mn_log_loss, auc]) AS estimate FROM k JOIN a USING (card))
SELECT card, metric, 'binary' AS estimator, round(estimate, 6) AS estimate FROM w""")
def metrics_long(spark, sf):
    m = metric_table(called(spark, sf).withColumnRenamed("risk", "p_event"), ["card"], discrete=True)
    return m.withColumn("estimate", r6("estimate"))


@query("nearest_either_side", f"""
WITH {DOC_ROC_SQL}, d AS (SELECT model, score, sensitivity, specificity, sign(specificity - 0.75::DOUBLE)::INT AS side, abs(specificity - 0.75::DOUBLE) AS distance FROM roc)
SELECT model, score, side, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM d
QUALIFY distance = min(distance) OVER (PARTITION BY model, side)""")
def nearest_points(spark, sf):
    totals = threshold_totals(doc_scores(spark, sf), ["model"], wide=True)
    near = nearest_either_side(roc_points(totals, ["model"]), ["model"], "specificity", F.lit(0.75))
    return near.select("model", "score", "side", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


@query("asof_scores", f"""
WITH {DOCS_SQL}, t AS (SELECT model, record_id, score FROM preds WHERE NOT is_event),
e AS (SELECT model, score AS hit, min(record_id) AS id FROM preds WHERE is_event GROUP BY ALL),
b AS (SELECT t.*, e.hit AS below, e.id AS below_id FROM t ASOF LEFT JOIN e ON t.model = e.model AND t.score >= e.hit),
a AS (SELECT b.*, e.hit AS above, e.id AS above_id FROM b ASOF LEFT JOIN e ON b.model = e.model AND b.score <= e.hit)
SELECT *, CASE WHEN below IS NULL OR above - score < score - below THEN above ELSE below END AS nearest FROM a""")
def asof_scores(spark, sf):
    """For every record without event the scores of the nearest records with one, on either side."""
    preds = doc_scores(spark, sf)
    with_event = preds.filter("is_event").select("model", "score", "record_id")
    found = asof_match(preds.filter("not is_event").select("model", "record_id", "score"), with_event, ["model"], "score", ["record_id"], ["record_id"])
    return nearest(found, "score").select(
        "model", "record_id", "score", F.col("below.score").alias("below"), F.col("below.record_id").alias("below_id"),
        F.col("above.score").alias("above"), F.col("above.record_id").alias("above_id"), F.col("nearest.score").alias("nearest"))


@query("gain_vs_guideline", f"""
WITH {ROC_SQL}, g AS (SELECT sensitivity AS g_sens, specificity AS g_spec FROM roc WHERE card = 'C0' AND score = 1),
d AS (SELECT card, score, specificity - g_spec AS ds, sensitivity - g_sens AS dt, sign(specificity - g_spec)::INT AS side FROM roc, g WHERE card <> 'C0')
SELECT card, score, side, round(ds, 6) AS specificity_diff, round(dt, 6) AS sensitivity_diff FROM d
QUALIFY abs(ds) = min(abs(ds)) OVER (PARTITION BY card, side)""")
def gain_vs_guideline(spark, sf):
    roc = roc_of(study(spark, sf))  # a few rows per card
    guide = roc.filter("card = 'C0' AND score = 1")
    spec, sens = guide.select("specificity").scalar(), guide.select("sensitivity").scalar()
    near = nearest_either_side(roc.filter("card <> 'C0'"), ["card"], "specificity", spec)
    return near.select(
        "card", "score", "side", r6(F.col("specificity") - spec).alias("specificity_diff"),
        r6(F.col("sensitivity") - sens).alias("sensitivity_diff"))


@query("model_types", """
SELECT source AS model, CASE WHEN source LIKE 's%' THEN 'generalized linear' WHEN contains(source, 'e') THEN 'rule/tree-based' END AS type,
  count(*) AS n FROM documents GROUP BY ALL""")
def model_types(spark, sf):
    """A family label per model name, by rule, NULL where no rule fits."""
    docs = table(spark, sf, "documents").groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n"))
    return docs.withColumn("type", F.when(
        F.col("model").startswith("s"), settings.MODEL_TYPES["logistic regression"]).when(
        F.col("model").contains("e"), settings.MODEL_TYPES["decision rules"]))


@query("filter_by_metric", f"""
WITH {ROC_SQL}, a AS (SELECT card, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc FROM totals GROUP BY card)
SELECT card, score, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM roc
WHERE card IN (SELECT card FROM a WHERE round(auc, 9) >= round((SELECT avg(auc) FROM a), 9))""")
def filter_by_metric(spark, sf):
    """Curves of the cards that are at least as good as the average one."""
    totals = card_totals(study(spark, sf))
    areas = settled(auc(totals, ["card"]))
    level = areas.agg(F.round(F.avg("roc_auc"), 9)).scalar()
    kept = roc_points(totals, ["card"]).join(areas.filter(F.round("roc_auc", 9) >= level), "card", "left_semi")
    return kept.withColumns({c: r6(c) for c in ("sensitivity", "specificity")})
