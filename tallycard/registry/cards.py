"""Score cards: points, risks, cutoffs and the tables made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.values import class_label, if_else
from tallycard.operators import cards as ops
from tallycard.operators.evaluate import screen_performance
from tallycard.operators.report import histogram, item_prevalence, log_odds
from tallycard.registry.base import query, r6
from tallycard.registry.evaluation import ROC_SQL, roc_of
from tallycard.registry.tables import PROTOTYPE_SQL, RISK_SQL, card_points, card_risks, prototype_table
from tallycard.session import settled
from tallycard.sources.fixtures import CARDS, FLAGS, SCORED_SQL, STUDY_SQL, order_side, study

BOUNDS = [6, 25]

COEF_SQL = STUDY_SQL + """,
u AS (UNPIVOT (SELECT is_event, hx_returned::INT AS hx_returned, hx_deep_discount::INT AS hx_deep_discount, hx_bulk::INT AS hx_bulk,
   hx_high_tax::INT AS hx_high_tax, hx_many::INT AS hx_many FROM study)
   ON hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many INTO NAME item VALUE v),
cell AS (SELECT item, sum(v * is_event::INT)::DOUBLE AS a, sum(v * (1 - is_event::INT))::DOUBLE AS b,
   sum((1 - v) * is_event::INT)::DOUBLE AS c, sum((1 - v) * (1 - is_event::INT))::DOUBLE AS d FROM u GROUP BY item),
coefs AS (SELECT item, ln((a + 0.5::DOUBLE) * (d + 0.5::DOUBLE) / ((b + 0.5::DOUBLE) * (c + 0.5::DOUBLE))) AS coef FROM cell),
bounds AS (SELECT unnest([6, 25])::INT AS bound),
points AS (SELECT bound, item, coef, max(abs(coef)) OVER (PARTITION BY bound) / bound AS denom FROM coefs, bounds),
pts AS (SELECT bound, item, coef, denom, round_even(coef / denom, 0)::INT AS points FROM points)"""


def fitted_points(spark, sf):
    """Integer points of per-item log odds ratios under each bound."""
    coefs = log_odds(item_prevalence(study(spark, sf), FLAGS))
    bounded = coefs.withColumn("bound", F.explode(F.lit(BOUNDS)))
    return ops.coef_to_points(bounded, ["bound"], F.col("bound"))


@query("coef_to_points", f"WITH {COEF_SQL} SELECT bound, item, round(coef, 6) AS coef, round(denom, 6) AS coef_denom, points FROM pts")
def coef_to_points(spark, sf):
    return fitted_points(spark, sf).select(
        "bound", "item", r6("coef").alias("coef"), r6("coef_denom").alias("coef_denom"), "points")


RANGE_SQL = COEF_SQL + """,
ends AS (SELECT bound, sum(least(points, 0))::INT AS lo, sum(greatest(points, 0))::INT AS hi, max(denom) AS denom FROM pts GROUP BY bound),
ranged AS (SELECT bound, unnest(range(lo, hi + 1))::INT AS score, denom FROM ends)"""


@query("score_range", f"WITH {RANGE_SQL} SELECT bound, score FROM ranged")
def score_range(spark, sf):
    return ops.score_range(fitted_points(spark, sf), ["bound"])


@query("score_risk", f"""
WITH {RANGE_SQL}
SELECT bound, score, round(1 / (1 + exp(-(-3 + score))), 6) AS raw_risk, round(1 / (1 + exp(-(-3 + denom * score))), 6) AS risk,
       round(1 / (1 + exp(-(-3 + score) / 2.0::DOUBLE)), 6) AS card_risk FROM ranged""")
def score_risk(spark, sf):
    pts = settled(fitted_points(spark, sf))
    denoms = pts.select("bound", "coef_denom").distinct()
    scores = ops.score_range(pts, ["bound"]).join(F.broadcast(denoms), "bound")
    s, b0 = F.col("score"), F.lit(-3.0)
    return scores.select(
        "bound", "score", r6(ops.risk_of(s, b0)).alias("raw_risk"),
        r6(ops.risk_of(s, b0, scale=F.col("coef_denom"))).alias("risk"),
        r6(ops.risk_of(s, b0, multiplier=F.lit(2.0))).alias("card_risk"))


@query("score_records", f"WITH {SCORED_SQL} SELECT record_id, card, score FROM scored")
def score_records(spark, sf):
    return ops.score_records(study(spark, sf), CARDS, ["record_id"]).drop("risk")


TARGET_SQL = ROC_SQL + """,
target AS (SELECT sum((NOT guideline AND NOT is_event)::INT)::DOUBLE / sum((NOT is_event)::INT)::DOUBLE AS spec FROM study)"""


def narrow_study(spark, sf):
    """What the cards need of the study table, written once for the steps below."""
    return settled(study(spark, sf).select("record_id", "is_event", "guideline", *FLAGS))


def guideline_specificity(s):
    perf = screen_performance(s, F.col("guideline"), F.col("is_event"))
    return settled(perf.select("specificity")).scalar()


CUTOFF_SQL = TARGET_SQL + """,
cutoffs AS (
  SELECT card, score AS score_cutoff, sensitivity, specificity FROM roc, target WHERE specificity >= spec - 0.05::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY card ORDER BY abs(specificity - spec), sensitivity DESC, score) = 1)"""


def cutoffs(s, roc=None):
    """One row per card; ``s`` as from ``narrow_study``."""
    return ops.anchored_cutoffs(
        roc or roc_of(s), ["card"], guideline_specificity(s), settings.SPECIFICITY_LOSS
    ).withColumnRenamed("score", "score_cutoff")


@query("cutoff_select", f"""
WITH {CUTOFF_SQL}
SELECT card, score_cutoff, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM cutoffs""")
def cutoff_select(spark, sf):
    return cutoffs(narrow_study(spark, sf)).select(
        "card", "score_cutoff", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


@query("flag_cutoff_points", f"""
WITH {CUTOFF_SQL}
SELECT r.card, r.score, round(r.sensitivity, 6) AS sensitivity, round(r.specificity, 6) AS specificity, c.card IS NOT NULL AS is_cutoff
FROM roc r LEFT JOIN cutoffs c ON r.card = c.card AND r.score = c.score_cutoff""")
def flag_cutoff_points(spark, sf):
    s = narrow_study(spark, sf)
    roc = roc_of(s)
    marks = cutoffs(s, roc).select("card", F.col("score_cutoff").alias("score"), F.lit(True).alias("mark"))
    flagged = roc.join(F.broadcast(marks), ["card", "score"], "left")
    return flagged.select(
        "card", "score", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"),
        F.coalesce("mark", F.lit(False)).alias("is_cutoff"))


@query("classify_at_cutoff", f"""
WITH {CUTOFF_SQL}
SELECT s.card, s.is_event, CASE WHEN s.score >= c.score_cutoff THEN 'Abnormal' ELSE 'Normal' END AS pred_class, count(*) AS n
FROM scored s JOIN cutoffs c ON s.card = c.card GROUP BY ALL""")
def classify_at_cutoff(spark, sf):
    s = narrow_study(spark, sf)
    scored = ops.score_records(s, CARDS, ["is_event"])
    called = ops.classify(scored, F.broadcast(cutoffs(s)), ["card"])
    return called.groupBy("card", "is_event", "pred_class").agg(F.count("*").alias("n"))


TWO_SIDED_SQL = TARGET_SQL + """,
sided AS (SELECT *, sign(specificity - spec)::INT AS side FROM roc, target),
two_sided AS (SELECT card, score, side, sensitivity, specificity FROM sided
  QUALIFY (side < 0 AND specificity = max(specificity) OVER (PARTITION BY card, side))
       OR (side > 0 AND specificity = min(specificity) OVER (PARTITION BY card, side)) OR side = 0)"""


def two_sided(s):
    return ops.two_sided_cutoffs(roc_of(s), ["card"], guideline_specificity(s))


@query("two_sided_cutoffs", f"""
WITH {TWO_SIDED_SQL}
SELECT card, score, side, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM two_sided""")
def two_sided_cutoffs(spark, sf):
    return two_sided(narrow_study(spark, sf)).select(
        "card", "score", "side", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


@query("risk_to_score", f"""
WITH {SCORED_SQL}, {RISK_SQL}, base AS (SELECT avg(is_event::INT) AS p FROM study),
l AS (SELECT card, score, risk, lag(risk) OVER (PARTITION BY card ORDER BY score) AS prior FROM card_risk)
SELECT card, score, round(risk, 6) AS risk FROM l, base WHERE risk >= 2 * p AND prior < 2 * p""")
def risk_to_score(spark, sf):
    """First score of each card with at least twice the prevalence."""
    prevalence = settled(study(spark, sf).agg(F.avg(F.col("is_event").cast("int")).alias("p"))).scalar()
    crossed = ops.risk_to_score(card_risks(spark), ["card"], prevalence * 2)
    return crossed.withColumn("risk", r6("risk"))


@query("score_risk_table", f"""
WITH {SCORED_SQL}, {RISK_SQL}, base AS (SELECT avg(is_event::INT) AS p FROM study),
c AS (SELECT card, score, sum((NOT is_event)::INT) AS neg, sum(is_event::INT) AS pos FROM scored GROUP BY ALL),
t AS (SELECT card, score, sum(neg) OVER w AS normal, sum(pos) OVER w AS abnormal, sum(neg + pos) OVER (PARTITION BY card) AS n
      FROM c WINDOW w AS (PARTITION BY card ORDER BY score DESC))
SELECT t.card, t.score, normal::BIGINT AS normal, abnormal::BIGINT AS abnormal, round((normal + abnormal)::DOUBLE / n::DOUBLE, 6) AS screen,
  round(risk, 6) AS risk, round(risk / p, 6) AS rel_risk
FROM t JOIN card_risk r ON t.card = r.card AND t.score = r.score, base""")
def score_risk_table(spark, sf):
    s = study(spark, sf)
    counts = settled(ops.score_counts_by_card(ops.score_records(s, CARDS, ["is_event"]), ["card"]))
    # every card scores the same records, so one card's counts give the prevalence
    one = counts.filter("card = 'C0'")
    prevalence = one.agg(F.sum("abnormal") / F.sum(F.col("normal") + F.col("abnormal"))).scalar()
    t = ops.score_risk_table(counts, F.broadcast(card_risks(spark)), ["card"], prevalence)
    return t.withColumns({c: r6(c) for c in ("screen", "risk", "rel_risk")})


@query("points_wide", f"""
WITH {COEF_SQL}, k AS (SELECT bound, item, points FROM pts)
SELECT bound, max(points) FILTER (item = 'hx_returned') AS hx_returned, max(points) FILTER (item = 'hx_deep_discount') AS hx_deep_discount,
  max(points) FILTER (item = 'hx_bulk') AS hx_bulk, max(points) FILTER (item = 'hx_high_tax') AS hx_high_tax, max(points) FILTER (item = 'hx_many') AS hx_many
FROM k GROUP BY bound""")
def points_wide(spark, sf):
    return ops.points_matrix(fitted_points(spark, sf), ["bound"], FLAGS)


@query("item_order", f"""
WITH {COEF_SQL}, m AS (SELECT item, max(abs(points)) AS largest FROM pts GROUP BY item HAVING max(abs(points)) > 0)
SELECT item, largest, rank() OVER (ORDER BY largest DESC)::INT AS place FROM m""")
def item_order(spark, sf):
    return ops.used_items(fitted_points(spark, sf))


@query("points_sign", f"WITH {COEF_SQL} SELECT bound, item, points, sign(points)::INT AS direction FROM pts")
def points_sign(spark, sf):
    return fitted_points(spark, sf).select(
        "bound", "item", "points", F.signum("points").cast("int").alias("direction"))


@query("select_candidates", f"""
WITH {COEF_SQL}
SELECT CASE bound WHEN 6 THEN 'Candidate 1' ELSE 'Candidate 2' END AS candidate, 'bound = ' || bound AS specification,
  item, points FROM pts
UNION ALL SELECT 'Candidate 0', 'guideline', 'guideline', 1""")
def select_candidates(spark, sf):
    chosen = spark.createDataFrame(
        [("bound = 6", "Candidate 1"), ("bound = 25", "Candidate 2")], "specification string, candidate string")
    pts = fitted_points(spark, sf).select(
        F.concat(F.lit("bound = "), F.col("bound").cast("string")).alias("specification"), "item", "points")
    guide = card_points(spark).filter("card = 'C0'").select(
        F.lit("Candidate 0").alias("candidate"), F.lit("guideline").alias("specification"), "item", "points")
    return pts.join(F.broadcast(chosen), "specification").unionByName(guide)


@query("detection_table", f"""
WITH {CUTOFF_SQL}, d0 AS (
  SELECT s.card, CASE WHEN s.is_event THEN 'Abnormal' ELSE 'Normal' END AS truth, CASE WHEN s.score >= c.score_cutoff THEN 'Yes' ELSE 'No' END AS screen,
         count(*) AS n
  FROM scored s JOIN cutoffs c ON s.card = c.card GROUP BY ALL),
d AS (SELECT *, n / sum(n) OVER (PARTITION BY card)::DOUBLE AS share FROM d0)
SELECT card, screen, sum(n) FILTER (truth = 'Normal')::BIGINT AS "Normal_n", round(sum(share) FILTER (truth = 'Normal'), 6) AS "Normal_share",
  sum(n) FILTER (truth = 'Abnormal')::BIGINT AS "Abnormal_n", round(sum(share) FILTER (truth = 'Abnormal'), 6) AS "Abnormal_share"
FROM d GROUP BY ALL""")
def detection_table(spark, sf):
    s = narrow_study(spark, sf)
    scored = ops.score_records(s, CARDS, ["is_event"])
    called = ops.classify(scored, F.broadcast(cutoffs(s)), ["card"]).withColumn(
        "truth", class_label(F.col("is_event")))
    t = ops.detection_table(called, ["card"])
    return t.withColumns({c: r6(c) for c in ("Normal_share", "Abnormal_share")})


@query("screen_discordance", f"""
WITH {CUTOFF_SQL}, v AS (
  SELECT record_id, max(CASE WHEN s.score >= c.score_cutoff THEN 'Y' ELSE 'N' END) FILTER (s.card = 'C0') AS "C0",
         max(CASE WHEN s.score >= c.score_cutoff THEN 'Y' ELSE 'N' END) FILTER (s.card = 'C1') AS "C1"
  FROM scored s JOIN cutoffs c ON s.card = c.card WHERE is_event GROUP BY record_id)
SELECT v.record_id, "C0", "C1", year(date_of_birth)::INT AS birth, substr(gender, 1, 1) AS gender, smoking_history_cigarette
FROM v JOIN cohort USING (record_id) WHERE "C0" <> "C1" """)
def screen_discordance(spark, sf):
    """Events that one card catches and the other misses, with attributes joined back."""
    s = narrow_study(spark, sf)
    cuts = ops.cutoff_values(cutoffs(s), "card", "score_cutoff")
    events = s.filter("is_event")
    screens = ops.screen_columns(events, CARDS, {c: cuts[c] for c in ("C0", "C1")}, ["record_id"])
    return screens.filter(F.col("C0") != F.col("C1")).join(order_side(spark, sf), "record_id", "left").select(
        "record_id", "C0", "C1", F.year("date_of_birth").alias("birth"),
        F.substring("gender", 1, 1).alias("gender"), "smoking_history_cigarette")


@query("screen_patterns", f"""
WITH {CUTOFF_SQL}, v AS (
  SELECT record_id, s.card, CASE WHEN s.score >= c.score_cutoff THEN 'Y' ELSE 'N' END AS screen
  FROM scored s JOIN cutoffs c ON s.card = c.card WHERE is_event),
p AS (SELECT record_id, string_agg(screen, '_' ORDER BY card) AS pattern FROM v GROUP BY record_id)
SELECT pattern, card AS tool, CASE screen WHEN 'Y' THEN 'Yes' ELSE 'No' END AS screen, count(*) AS n FROM v JOIN p USING (record_id) GROUP BY ALL""")
def screen_patterns(spark, sf):
    """Records per pattern of screens, with one row per pattern and tool."""
    s = narrow_study(spark, sf)
    cuts = ops.cutoff_values(cutoffs(s), "card", "score_cutoff")
    names = sorted(cuts)
    screens = ops.screen_columns(s.filter("is_event"), CARDS, {c: cuts[c] for c in names}, ["record_id"])
    counted = ops.pattern_counts(screens, names)
    return ops.pattern_flows(counted, names).withColumn(
        "screen", if_else(F.col("screen") == "Y", F.lit("Yes"), F.lit("No")))


@query("screen_patterns_two_sided", f"""
WITH {TWO_SIDED_SQL}, used AS (SELECT card, score, card || '@' || score AS tool FROM two_sided),
v AS (SELECT record_id, tool, CASE WHEN s.score >= u.score THEN 'Y' ELSE 'N' END AS screen FROM scored s JOIN used u ON s.card = u.card WHERE is_event),
p AS (SELECT record_id, string_agg(screen, '_' ORDER BY tool) AS pattern FROM v GROUP BY record_id)
SELECT pattern, count(*) AS n FROM p GROUP BY pattern""")
def screen_patterns_two_sided(spark, sf):
    """The same over the cutoffs on both sides of the guideline's specificity."""
    s = narrow_study(spark, sf)
    rows = two_sided(s).select("card", "score").collect()  # a few rows per card
    cuts = {f"{r['card']}@{r['score']}": r["score"] for r in rows}
    names = sorted(cuts)
    screens = ops.screen_columns(s.filter("is_event"), CARDS, {c: cuts[c] for c in names}, ["record_id"])
    return ops.pattern_counts(screens, names)


@query("prototype_scores", f"""
WITH {CUTOFF_SQL}, {PROTOTYPE_SQL},
ps AS (
  SELECT subject, 'C1' AS card, 3 * hx_returned - 2 * hx_bulk + 5 * hx_many AS total FROM prototypes
  UNION ALL SELECT subject, 'C2', hx_deep_discount + 2 * hx_high_tax - hx_many FROM prototypes)
SELECT ps.card, ps.subject, ps.total::INT AS total, CASE WHEN ps.total >= c.score_cutoff THEN 'Y' ELSE 'N' END AS screen
FROM ps JOIN cutoffs c ON ps.card = c.card""")
def prototype_scores(spark, sf):
    """Prototype subjects under each card at the cutoff chosen on the cohort."""
    scored = ops.score_records(prototype_table(spark), {k: CARDS[k] for k in ("C1", "C2")}, ["subject"])
    called = ops.classify(scored, F.broadcast(cutoffs(narrow_study(spark, sf))), ["card"])
    return called.select(
        "card", "subject", F.col("score").alias("total"),
        if_else(F.col("pred_class") == "Abnormal", F.lit("Y"), F.lit("N")).alias("screen"))


@query("prototype_contributions", f"""
WITH {COEF_SQL}, {PROTOTYPE_SQL},
e AS (UNPIVOT prototypes ON hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many INTO NAME item VALUE entry),
x AS (SELECT bound, subject, item, entry::INT AS entry, points, (entry * points)::INT AS value FROM e JOIN pts USING (item))
SELECT *, sum(value) OVER (PARTITION BY bound, subject)::INT AS total FROM x""")
def prototype_contributions(spark, sf):
    return ops.contributions(prototype_table(spark), fitted_points(spark, sf), FLAGS, ["subject"], ["bound"])


def _tally_sql(card: str) -> str:
    points = CARDS[card][2]
    cell = lambda f: f"CASE WHEN {f} = 0 THEN '' ELSE '{points[f]}' END" if points.get(f) else "'--'"
    total = " + ".join(f"{v} * {f}" for f, v in points.items())
    return f"SELECT '{card}' AS card, subject, {', '.join(f'{cell(f)} AS {f}' for f in FLAGS)}, ({total})::INT AS total FROM prototypes"


@query("prototype_tally", f"""
WITH {CUTOFF_SQL}, {PROTOTYPE_SQL}, t AS ({_tally_sql("C1")} UNION ALL {_tally_sql("C2")})
SELECT t.*, CASE WHEN t.total >= c.score_cutoff THEN 'Y' ELSE 'N' END AS screen FROM t JOIN cutoffs c ON t.card = c.card""")
def prototype_tally(spark, sf):
    """The display of the prototype subjects: a cell per item, the total, and the screen."""
    used = [(card, f, v) for card in ("C1", "C2") for f, v in CARDS[card][2].items() if v]
    points = spark.createDataFrame(used, "card string, item string, points int")
    shown = ops.tally_table(prototype_table(spark), points, FLAGS, ["subject"], ["card"])
    cut = cutoffs(narrow_study(spark, sf)).select("card", "score_cutoff")
    return shown.join(F.broadcast(cut), "card").withColumn("screen", F.when(F.col("total") >= F.col("score_cutoff"), "Y").otherwise("N")).drop("score_cutoff")


@query("score_histogram", f"""
WITH {SCORED_SQL} SELECT card, score::BIGINT AS bin, count(*) AS n FROM scored GROUP BY ALL""")
def score_histogram(spark, sf):
    scored = ops.score_records(study(spark, sf), CARDS, [])
    return histogram(scored, "score", F.lit(1), by=["card"])
