"""Third round: cards from chosen settings, judged on the held-out records.

Results are flat tables keyed by card, not nested ones: models, points, risks,
predictions, cutoffs, metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.models.batch_fit import FitSpec, fit_many
from tallycard.models.card_search import search_cards
from tallycard.models.guideline import rule_shares
from tallycard.operators import cards as ops
from tallycard.operators.encode import Encoder, patterns
from tallycard.operators.evaluate import metric_table, roc_points, screen_performance, threshold_totals
from tallycard.session import settled


@dataclass(frozen=True)
class Evaluation:
    models: DataFrame
    points: DataFrame
    risks: DataFrame
    predictions: DataFrame
    roc: DataFrame
    cutoffs: DataFrame
    metrics: DataFrame


GUIDELINE = "guideline"


def ridge_cards(spark: SparkSession, pats: DataFrame, features: list[str], penalties: list[float],
                bounds: list[int]) -> tuple[dict[str, ops.Card], list[tuple]]:
    """Ridge fits, all at once, rounded to points under every bound.

    A card's multiplier is one over the coefficient worth of a point and its
    intercept is scaled alike, so its risk is that of the fit up to rounding.
    """
    fits = fit_many(pats, [FitSpec(repr(p), tuple(features), p) for p in penalties])
    coefs = spark.createDataFrame(
        [(name, i, c) for name, f in fits.items() for i, c in f.coefs.items()], "penalty string, item string, coef double")
    bounded = coefs.withColumn("bound", F.explode(F.lit(bounds)))
    pointed = ops.coef_to_points(bounded, ["penalty", "bound"], F.col("bound"))
    cards: dict[str, ops.Card] = {}
    facts: dict[str, tuple] = {}
    for r in pointed.collect():  # penalties x bounds x items rows
        name = f"ridge (penalty = {float(r['penalty']):g}, bound = {r['bound']})"
        b0 = fits[r["penalty"]].intercept
        worth = r["coef_denom"] or 1.0
        card = cards.setdefault(name, (b0 / worth, 1 / worth, {}))
        card[2][r["item"]] = int(r["points"] or 0)
        facts[name] = (name, "logistic regression", float(r["penalty"]), None, int(r["bound"]), None)
    return cards, list(facts.values())


def searched_cards(pats: DataFrame, features: list[str], terms: list[int], bounds: list[int], pool: int, beam: int,
                   multipliers: int) -> tuple[dict[str, ops.Card], list[tuple]]:
    cards: dict[str, ops.Card] = {}
    facts = []
    for (t, b), found in search_cards(pats, features, terms, bounds, pool, beam, multipliers).items():
        for c in found:
            name = f"integer card (terms = {t}, bound = {b}; #{c.number})"
            cards[name] = (c.intercept, c.multiplier, c.points)
            facts.append((name, "integer card", None, t, b, c.number))
    return cards, facts


def evaluate(
    spark: SparkSession, train: DataFrame, test: DataFrame, columns: list[str], rule: Column,
    penalties: list[float] = settings.FINAL_PENALTIES, bounds: list[int] = settings.FINAL_BOUNDS,
    terms: list[int] = settings.FINAL_TERMS, loss: float = settings.SPECIFICITY_LOSS, pool: int = 2, beam: int = 12,
    multipliers: int = 24, target_on_test: bool = False,
) -> Evaluation:
    """Fit every card on ``train`` and judge all of them on ``test`` in one pass.

    ``referent_risk`` of a card is what a record without any item brings, on the
    scale of the points; ``score_adj`` is a score with it, on the log odds scale.
    Both tables carry record_id, is_event, the predictors, and whatever ``rule``
    (the existing guideline) needs. Cutoffs aim at the guideline's specificity,
    by default as measured on the training records.
    """
    carry = ["record_id", "is_event", GUIDELINE]
    enc = Encoder(columns, carry).fit(train)
    coded_train = settled(enc.transform(train.withColumn(GUIDELINE, rule)))
    coded_test = settled(enc.transform(test.withColumn(GUIDELINE, rule)))
    pats = settled(patterns(coded_train, enc.features))

    shares = {r["score"]: r["risk"] for r in rule_shares(coded_train, F.col(GUIDELINE)).collect()}
    ridge, ridge_facts = ridge_cards(spark, pats, enc.features, penalties, bounds)
    found, found_facts = searched_cards(pats, enc.features, terms, bounds[1:], pool, beam, multipliers)
    cards = {GUIDELINE: (0.0, 1.0, {GUIDELINE: 1}), **ridge, **found}
    facts = [(GUIDELINE, GUIDELINE, None, None, None, None), *ridge_facts, *found_facts]

    guideline_risk = F.when(F.col("score") == 1, F.lit(shares.get(1))).otherwise(F.lit(shares.get(0)))
    own_risk = lambda c: F.when(F.col("card") == GUIDELINE, guideline_risk).otherwise(F.col(c))
    scored = ops.score_records(coded_test, cards, ["record_id", "is_event"]).withColumn("risk", own_risk("risk"))

    models = spark.createDataFrame(
        [(*f, *cards[f[0]][:2], cards[f[0]][0]) for f in facts],
        "card string, family string, penalty double, terms int, bound int, number int, intercept double, multiplier double, "
        "referent_risk double")
    points = spark.createDataFrame(
        [(k, i, p) for k, (_, _, pts) in cards.items() for i, p in pts.items()], "card string, item string, points int")
    risks = ops.score_range(points, ["card"]).join(models, "card").select(
        "card", "score", ((F.col("score") + F.col("referent_risk")) / F.col("multiplier")).alias("score_adj"),
        ops.risk_of(F.col("score"), F.col("intercept"), F.col("multiplier")).alias("risk")
    ).withColumn("risk", own_risk("risk"))

    roc = settled(roc_points(threshold_totals(scored, ["card"]), ["card"]))
    measured = coded_test if target_on_test else coded_train
    target = settled(screen_performance(measured, F.col(GUIDELINE), F.col("is_event")).select("specificity")).scalar()
    # the guideline's own cutoff is nearest without a loss limit
    cut = ops.anchored_cutoffs(roc.filter(F.col("card") != GUIDELINE), ["card"], target, loss).unionByName(
        ops.anchored_cutoffs(roc.filter(F.col("card") == GUIDELINE), ["card"], target, 1.0))
    cutoffs = settled(cut.join(risks, ["card", "score"], "left").select(
        "card", F.col("score").alias("score_cutoff"), F.col("risk").alias("risk_cutoff"), "specificity", "sensitivity"))
    predictions = ops.classify(scored, F.broadcast(cutoffs), ["card"])
    metrics = metric_table(predictions, ["card"], prob="risk", discrete=True)
    return Evaluation(models, points, risks, predictions, roc, cutoffs, metrics)
