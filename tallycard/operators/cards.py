"""Score cards: points, scores, risks, cutoffs and the tables made from them.

A card is a small parameter (item -> points), so scoring is a generated
expression per card: no join, no shuffle, any number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycard.functions.values import if_else, logistic, ratio
from tallycard.operators.evaluate import keep_extreme, pick_best
from tallycard.operators.prefix import running_totals, same_keys

Card = tuple[float, float, dict[str, int]]  # intercept, multiplier, points


def coef_to_points(coefs: DataFrame, keys: list[str], bound: Column) -> DataFrame:
    """Scale each model's largest |coefficient| to ``bound`` and round half to even.

    ``coefs``: keys, item, coef (intercept apart). Adds points and coef_denom,
    the coefficient worth of one point.
    """
    w = Window.partitionBy(*keys)
    denom = F.max(F.abs("coef")).over(w) / bound
    return coefs.withColumn("coef_denom", denom).withColumn(
        "points", F.bround(ratio(F.col("coef"), F.col("coef_denom")), 0).cast("int"))


def score_range(points: DataFrame, keys: list[str]) -> DataFrame:
    """Every integer score between the smallest and the largest possible total."""
    ends = points.groupBy(*keys).agg(
        F.sum(F.least("points", F.lit(0))).cast("int").alias("lo"),
        F.sum(F.greatest("points", F.lit(0))).cast("int").alias("hi"))
    return ends.select(*keys, F.explode(F.sequence("lo", "hi")).alias("score"))


def risk_of(score: Column, intercept: Column, multiplier: Column | None = None,
            scale: Column | None = None) -> Column:
    """Risk of a score.

    ``multiplier``: (intercept + score) / multiplier, for searched cards.
    ``scale``: intercept + scale * score, for rounded coefficients, where scale
    is coef_denom; without it the score is added as it is.
    """
    if multiplier is not None:
        return logistic((intercept + score) / multiplier)
    return logistic(intercept + (score if scale is None else score * scale))


def card_score(points: dict[str, int]) -> Column:
    """Total points of one record under one card; NULL if any used item is NULL."""
    total = F.lit(0)
    for item, value in points.items():
        if value:
            total = total + F.col(item).cast("int") * F.lit(int(value))
    return total


def score_records(df: DataFrame, cards: dict[str, Card], keep: list[str]) -> DataFrame:
    """One row per record and card: score and risk. Map-only."""
    rows = [
        F.struct(
            F.lit(name).alias("card"), card_score(points).alias("score"),
            risk_of(card_score(points), F.lit(float(b0)), F.lit(float(m))).alias("risk"),
        )
        for name, (b0, m, points) in cards.items()
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def cards_from_points(points: DataFrame, key: str, intercept: str = "intercept",
                      multiplier: str = "multiplier") -> dict[str, Card]:
    """Fitted points as parameters. Bounded: cards x items rows."""
    cards: dict[str, Card] = {}
    for r in points.select(key, intercept, multiplier, "item", "points").collect():
        card = cards.setdefault(r[key], (float(r[intercept]), float(r[multiplier]), {}))
        card[2][r["item"]] = int(r["points"])
    return cards


# ---- cutoffs ---------------------------------------------------------------


def anchored_cutoffs(points: DataFrame, keys: list[str], target: Column, loss: float,
                     all_ties: bool = False) -> DataFrame:
    """Threshold with specificity nearest to ``target``, at most ``loss`` below it.

    Among equally near ones the more sensitive, then the lower score, unless
    ``all_ties``.
    """
    near = points.filter(F.col("specificity") >= target - loss).withColumn(
        "distance", F.abs(F.col("specificity") - target))
    if all_ties:
        return keep_extreme(near, keys, "distance", largest=False)
    return pick_best(near, keys, [F.col("distance"), -F.col("sensitivity"), F.col("score")])


def two_sided_cutoffs(points: DataFrame, keys: list[str], target: Column) -> DataFrame:
    """Greatest specificity below, least above, and every exact hit of ``target``."""
    sided = points.withColumn("side", F.signum(F.col("specificity") - target).cast("int"))
    ends = sided.groupBy(*keys, "side").agg(
        F.max("specificity").alias("_max"), F.min("specificity").alias("_min"))
    joined = same_keys(sided, ends, [*keys, "side"])
    wanted = F.when(F.col("side") < 0, F.col("_max")).when(F.col("side") > 0, F.col("_min")).otherwise(
        F.col("specificity"))
    return joined.filter(F.col("specificity") == wanted).drop("_max", "_min")


def risk_to_score(score_risk: DataFrame, keys: list[str], cutoff: Column) -> DataFrame:
    """First score whose risk reaches ``cutoff`` while the one before stays below."""
    w = Window.partitionBy(*keys).orderBy("score")
    crossed = score_risk.withColumn("_prior", F.lag("risk").over(w))
    return crossed.filter((F.col("risk") >= cutoff) & (F.col("_prior") < cutoff)).drop("_prior")


def classify(scored: DataFrame, cutoffs: DataFrame, keys: list[str], cutoff: str = "score_cutoff") -> DataFrame:
    """Class of every scored record at its card's cutoff (one row per card)."""
    joined = scored.join(cutoffs.select(*keys, cutoff), keys)
    return joined.withColumn(
        "pred_class", F.when(F.col("score") >= F.col(cutoff), "Abnormal").otherwise("Normal"))


# ---- report tables ---------------------------------------------------------


def screened_share(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Share of all records at or above each score seen."""
    counts = scored.groupBy(*keys, "score").agg(F.count("*").alias("n"))
    ran = running_totals(counts, keys, "score", ["n"], descending=True)
    return ran.select(*keys, "score", "n", (F.col("cum_n") / F.col("tot_n")).alias("screen"))


def score_counts_by_card(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, "score").agg(
        F.sum((~F.col("is_event")).cast("long")).alias("normal"),
        F.sum(F.col("is_event").cast("long")).alias("abnormal"))


def score_risk_table(counts: DataFrame, score_risk: DataFrame, keys: list[str], prevalence: Column) -> DataFrame:
    """Risk, relative risk, share screened and cases at or above each score seen.

    ``counts`` comes from ``score_counts_by_card``; scores never seen are left out.
    """
    ran = running_totals(counts, keys, "score", ["normal", "abnormal"], descending=True)
    seen = ran.select(
        *keys, "score",
        ((F.col("cum_normal") + F.col("cum_abnormal"))
         / (F.col("tot_normal") + F.col("tot_abnormal"))).alias("screen"),
        F.col("cum_normal").alias("normal"), F.col("cum_abnormal").alias("abnormal"))
    return seen.join(score_risk, [*keys, "score"]).withColumn("rel_risk", F.col("risk") / prevalence)


def detection_table(classified: DataFrame, keys: list[str], truth: str = "truth") -> DataFrame:
    """Counts and shares by truth and screen, one column pair per truth."""
    counts = classified.groupBy(*keys, truth, "pred_class").agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    screen = F.when(F.col("pred_class") == "Normal", "No").otherwise("Yes").alias("screen")
    return (
        shared.groupBy(*keys, screen).pivot(truth, ["Normal", "Abnormal"])
        .agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    )


def points_matrix(points: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """One row per card, one column per item."""
    return points.groupBy(*keys).pivot("item", items).agg(F.first("points"))


def used_items(points: DataFrame) -> DataFrame:
    """Items some card uses, with their largest |points| and place by it."""
    largest = points.groupBy("item").agg(F.max(F.abs("points")).alias("largest")).filter("largest > 0")
    by_size = Window.orderBy(F.col("largest").desc())  # one row per item
    return largest.withColumn("place", F.rank().over(by_size))


def screen_columns(df: DataFrame, cards: dict[str, Card], cutoffs: dict[str, float], keep: list[str]) -> DataFrame:
    """One row per record with a Y/N column per card and cutoff. Map-only.

    ``cutoffs``: column name -> cutoff; names are cards, or card@anything when a
    card is used with several cutoffs.
    """
    return df.select(*keep, *[
        if_else(card_score(cards[name.split("@")[0]][2]) >= cut, F.lit("Y"), F.lit("N")).alias(name)
        for name, cut in cutoffs.items()
    ])


def cutoff_values(cutoffs: DataFrame, name: str, cutoff: str = "score") -> dict[str, float]:
    """Chosen cutoffs as parameters: one row per card."""
    return {r[name]: r[cutoff] for r in cutoffs.select(name, cutoff).collect()}


def pattern_counts(screens: DataFrame, names: list[str]) -> DataFrame:
    """How many records show each combination of screening results."""
    text = F.concat_ws("_", *[F.col(n) for n in names])
    return screens.groupBy(text.alias("pattern")).agg(F.count("*").alias("n"))


def pattern_flows(counted: DataFrame, names: list[str]) -> DataFrame:
    """One row per pattern and tool, in long form."""
    marks = F.split("pattern", "_")
    return counted.select("pattern", "n", F.inline(F.array(*[
        F.struct(F.lit(t).alias("tool"), marks.getItem(i).alias("screen")) for i, t in enumerate(names)
    ])))


def contributions(subjects: DataFrame, points: DataFrame, items: list[str], ids: list[str], keys: list[str]) -> DataFrame:
    """What each item adds to each subject's total under each card (few subjects)."""
    entries = subjects.unpivot(ids, items, "item", "entry")
    joined = entries.join(F.broadcast(points.select(*keys, "item", "points")), "item")
    valued = joined.withColumn("value", F.col("entry") * F.col("points"))
    total = F.sum("value").over(Window.partitionBy(*keys, *ids)).cast("int")
    return valued.withColumn("total", total)


def tally_table(subjects: DataFrame, points: DataFrame, items: list[str], ids: list[str], keys: list[str]) -> DataFrame:
    """A row per card and subject with a text per item: "--" where the card has no such item, nothing where the subject
    has not got it, else what it adds. Then the ``total``. ``points`` holds the items each card uses.
    """
    valued = contributions(subjects, points, items, ids, keys)
    tally = F.when(F.col("entry") == 0, "").otherwise(F.col("value").cast("int").cast("string"))
    wide = valued.withColumn("tally", tally).groupBy(*keys, *ids).pivot("item", items).agg(F.first("tally"))
    totals = valued.groupBy(*keys, *ids).agg(F.sum("value").cast("int").alias("total"))
    return wide.na.fill("--", items).join(totals, [*keys, *ids]).select(*keys, *ids, *items, "total")
