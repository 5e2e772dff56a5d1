"""Confusion tables, ROC and precision-recall curves, metrics; many models at once.

Keys (model, predictors, response, …) are grouping columns, never loops. Rows
are counted per distinct score before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycard.functions.values import ratio
from tallycard.operators.prefix import running_totals, same_keys
from tallycard.session import settled


def screen_performance(df: DataFrame, screen: Column, event: Column, keys: list[str] = ()) -> DataFrame:
    """Quadrants and rates of a yes/no screen; undefined ratios are NULL."""
    tally = lambda test: F.sum(F.when(test, 1).otherwise(0))
    quadrants = df.groupBy(*keys).agg(
        tally(screen & event).alias("tp"),
        tally(~screen & ~event).alias("tn"),
        tally(screen & ~event).alias("fp"),
        tally(~screen & event).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return quadrants.withColumns({
        "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    })


def confusion_counts(df: DataFrame, keys: list[str], pred: str = "pred_class", truth: str = "truth") -> DataFrame:
    return df.groupBy(*keys, pred, truth).agg(F.count("*").alias("n"))


def score_counts(df: DataFrame, keys: list[str], score: str, event: str) -> DataFrame:
    """Positives and negatives per distinct score; NULL scores or truths are left out."""
    known = df.filter(F.col(score).isNotNull() & F.col(event).isNotNull())
    hit = F.col(event).cast("long")
    return known.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def threshold_totals(
    df: DataFrame, keys: list[str], score: str = "score", event: str = "is_event",
    wide: bool | None = None, counted: bool = False,
) -> DataFrame:
    """Per distinct score: records at or above it, by truth (cum_*, tot_*).

    ``wide`` defaults to True for fractional scores, see ``running_totals``.
    ``counted`` marks input that already has pos and neg per score.
    """
    if wide is None:
        wide = dict(df.dtypes)[score] in ("double", "float")
    counts = df.withColumnRenamed(score, "score") if counted else score_counts(df, keys, score, event)
    return running_totals(counts, keys, "score", ["pos", "neg"], descending=True, wide=wide)


def roc_points(totals: DataFrame, keys: list[str]) -> DataFrame:
    """ROC point at every threshold: predicted positive is score >= threshold."""
    return totals.select(
        *keys, "score",
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("sensitivity"),
        (1 - ratio(F.col("cum_neg"), F.col("tot_neg"))).alias("specificity"),
    )


def roc_curve(df: DataFrame, keys: list[str], score: str = "score", event: str = "is_event",
              wide: bool | None = None) -> DataFrame:
    """All ROC points plus the two ends (threshold NULL, see ``point_kind``)."""
    wide = dict(df.dtypes)[score] in ("double", "float") if wide is None else wide
    counts = settled(score_counts(df, keys, score, event))  # points and ends both start from it
    totals = threshold_totals(counts, keys, "score", event, wide, counted=True)
    points = roc_points(totals, keys).withColumn("point_kind", F.lit("score"))
    groups = counts.select(*keys).distinct()
    ends = groups.select(
        *keys,
        F.inline(F.array(
            F.struct(F.lit(1.0).alias("sensitivity"), F.lit(0.0).alias("specificity"),
                     F.lit("low_end").alias("point_kind")),
            F.struct(F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("specificity"),
                     F.lit("high_end").alias("point_kind")),
        )),
    )
    return points.unionByName(ends, allowMissingColumns=True)


def pr_curve(df: DataFrame, keys: list[str], score: str = "score", event: str = "is_event",
             wide: bool | None = None) -> DataFrame:
    """Precision-recall points; the curve starts at recall 0, precision 1."""
    wide = dict(df.dtypes)[score] in ("double", "float") if wide is None else wide
    counts = settled(score_counts(df, keys, score, event))  # points and starts both start from it
    totals = threshold_totals(counts, keys, "score", event, wide, counted=True)
    points = totals.select(
        *keys, "score",
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.lit("score").alias("point_kind"),
    )
    groups = counts.select(*keys).distinct()
    start = groups.select(*keys, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"),
                          F.lit("start").alias("point_kind"))
    return points.unionByName(start, allowMissingColumns=True)


def area() -> Column:
    """Aggregate over ``threshold_totals`` rows: area under the ROC curve, ties count half.

    A threshold adds its negatives times the positives above it, plus half of
    the positives tied with them; sums need no neighbour row.
    """
    above = F.col("cum_pos") - F.col("pos")
    wins = F.sum(F.col("neg") * (above.cast("double") + F.col("pos") / 2))
    return ratio(wins, F.max(F.col("tot_pos").cast("double") * F.col("tot_neg")))


def auc(totals: DataFrame, keys: list[str]) -> DataFrame:
    return totals.groupBy(*keys).agg(area().alias("roc_auc"))


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", event: str = "is_event",
            wide: bool | None = None, counted: bool = False) -> DataFrame:
    return auc(threshold_totals(df, keys, score, event, wide, counted), keys)


def pr_auc(df: DataFrame, keys: list[str], score: str = "score", event: str = "is_event",
           wide: bool | None = None) -> DataFrame:
    """Trapezoid area under the precision-recall curve.

    The previous point of a threshold follows from its own totals minus its own
    counts, so again no neighbour row is needed.
    """
    totals = threshold_totals(df, keys, score, event, wide)
    seen = F.col("cum_pos") + F.col("cum_neg")
    before = seen - F.col("pos") - F.col("neg")
    here = F.col("cum_pos") / seen
    prior = F.when(before > 0, F.try_divide((F.col("cum_pos") - F.col("pos")), before)).otherwise(1.0)
    step = ratio(F.col("pos"), F.col("tot_pos"))
    return totals.groupBy(*keys).agg(F.sum(step * (here + prior) / 2).alias("pr_auc"))


def metric_table(df: DataFrame, keys: list[str], prob: str = "p_event", pred: str = "pred_class",
                 event: str = "is_event", event_label: str = "Abnormal", discrete: bool = False,
                 counted: bool = False) -> DataFrame:
    """Long metric table: accuracy, Cohen's kappa, mean log loss, area under ROC.

    One pass over the rows, which are counted per distinct probability;
    ``discrete`` says that there are few of those (a score card). ``counted``
    input has pos and n per row in place of the event.
    """
    called = (F.col(pred) == event_label).cast("long")
    if counted:
        hit, miss = F.col("pos"), F.col("n") - F.col("pos")
        known = df.filter(F.col(prob).isNotNull())
    else:
        hit = F.col(event).cast("long")
        miss = 1 - hit
        known = df.filter(F.col(event).isNotNull() & F.col(prob).isNotNull())
    counts = known.groupBy(*keys, F.col(prob).alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(miss).alias("neg"),
        F.sum(hit * called).alias("tp"), F.sum(miss * called).alias("fp"))
    totals = running_totals(counts, keys, "score", ["pos", "neg"], descending=True, wide=not discrete)
    tiny = 2.220446049250313e-16
    p = F.greatest(F.lit(tiny), F.least(F.lit(1 - tiny), F.col("score")))
    flat = totals.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        (-F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p))).alias("loss"), area().alias("roc_auc"))
    n, called_n = F.col("n_pos") + F.col("n_neg"), F.col("tp") + F.col("fp")
    observed = ratio(F.col("tp") + F.col("n_neg") - F.col("fp"), n)
    chance = ratio(
        called_n.cast("double") * F.col("n_pos") + (n - called_n).cast("double") * F.col("n_neg"),
        n.cast("double") * n)
    named = flat.select(
        *keys, observed.alias("accuracy"), ratio(observed - chance, 1 - chance).alias("kap"),
        ratio(F.col("loss"), n).alias("mn_log_loss"), "roc_auc")
    return long_metrics(named, keys, ["accuracy", "kap", "mn_log_loss", "roc_auc"])


def long_metrics(wide_df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return wide_df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit("binary").alias("estimator"),
                     F.col(m).cast("double").alias("estimate")) for m in names
        ])),
    )


def keep_extreme(df: DataFrame, keys: list[str], value: str, largest: bool = True,
                 digits: int | None = None) -> DataFrame:
    """Rows that hold their group's extreme value, ties kept.

    The extreme is a partial aggregate joined back, so a large group is never
    sorted in one task. ``digits`` compares rounded values, since the last bit
    of a mean depends on the order of summation.
    """
    key_value = F.round(value, digits) if digits is not None else F.col(value)
    best = df.groupBy(*keys).agg((F.max if largest else F.min)(key_value).alias("_best"))
    if not keys:
        return df.filter(key_value == best.scalar())
    return same_keys(df, best, list(keys)).filter(key_value == F.col("_best")).drop("_best")


def pick_best(df: DataFrame, keys: list[str], ranking: list[Column]) -> DataFrame:
    """One row per group: the smallest by ``ranking`` (a total order), by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*ranking)).alias("_row"))
        .select(*keys, "_row.*")
    )


def sensitivity_gain(points: DataFrame) -> DataFrame:
    """Gain over random screening at the same specificity."""
    return points.withColumn("gain", F.col("sensitivity") - 1 + F.col("specificity"))


def gain_summary(points: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """Each model's least and greatest peak gain over its specifications."""
    peaks = sensitivity_gain(points).groupBy(model, *keys).agg(F.max("gain").alias("peak"))
    return peaks.groupBy(model).agg(F.min("peak").alias("least_peak_gain"), F.max("peak").alias("greatest_peak_gain"))


def nearest_either_side(points: DataFrame, keys: list[str], value: str, target: Column) -> DataFrame:
    """Points closest to ``target`` below, at and above it; ties kept."""
    sided = points.withColumns({
        "side": F.signum(F.col(value) - target).cast("int"),
        "distance": F.abs(F.col(value) - target),
    })
    return keep_extreme(sided, [*keys, "side"], "distance", largest=False)


def mean_interval(metrics: DataFrame, over: list[str], value: str = "estimate") -> DataFrame:
    """Mean, sd and standard error over replicates, grouped by all other columns."""
    keys = [c for c in metrics.columns if c not in (*over, value)]
    return metrics.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"),
    ).withColumns({
        "se": F.col("sd") / F.sqrt("n"),
        "low": F.col("mean") - 2 * F.col("sd"),
        "high": F.col("mean") + 2 * F.col("sd"),
    })


def best_settings(summary: DataFrame, keys: list[str], preference: list[Column] | None = None,
                  digits: int = 9) -> DataFrame:
    """Settings with the greatest mean per group; ties kept, or cut by preference."""
    best = keep_extreme(summary, keys, "mean", digits=digits)
    if not preference:
        return best
    w = Window.partitionBy(*keys).orderBy(*preference)
    return best.withColumn("_pref", F.rank().over(w)).filter("_pref = 1").drop("_pref")

