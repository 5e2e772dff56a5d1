"""Scalar functions, aggregates, windows, sampling, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.values import (
    any_true, if_else, is_one_of, joined_text, keep_levels, number_text, percent_text, ratio, replace_first,
    setting_text,
)
from tallycard.operators import clean, report, resample
from tallycard.operators.cards import score_records, screened_share
from tallycard.operators.encode import levels_present
from tallycard.operators.evaluate import (
    area, best_settings, gain_summary as peak_gains, long_metrics, mean_interval, roc_points, screen_performance,
    threshold_totals,
)
from tallycard.operators.prefix import numbered
from tallycard.registry.base import query, r6
from tallycard.registry.tables import AGE_SQL
from tallycard.session import settled
from tallycard.sources.fixtures import (
    CARDS, COHORT_SQL, FLAGS, SCORED_SQL, STUDY_SQL, cohort, guideline_v1, guideline_v2, order_side, study, table,
)

# ---- scalar functions ------------------------------------------------------


@query("stratum_case", f"""
WITH {COHORT_SQL}
SELECT genotype, CASE WHEN genotype IN ('SZ', 'ZZ', 'MM') THEN genotype ELSE 'Ab' END AS stratum, count(*) AS n
FROM cohort GROUP BY ALL""")
def stratum_case(spark, sf):
    c = order_side(spark, sf).withColumn("stratum", resample.genotype_stratum())
    return c.groupBy("genotype", "stratum").agg(F.count("*").alias("n"))


@query("string_fns", """
SELECT source, lower(lang) AS lang, contains(text, 'e') AS has_e, substr(source, 1, 3) AS head,
       sum(length(regexp_replace(text, '[aeiou]', '##')))::BIGINT AS replaced_chars,
       coalesce(lang IN ('en', 'de'), false) AS listed, regexp_replace(source, '[0-9]', '') AS bare,
       source || ':' || lang AS pasted, count(*) AS n
FROM documents GROUP BY ALL""")
def string_fns(spark, sf):
    text = F.col("text")
    derived = table(spark, sf, "documents").select(
        "source", F.lower("lang").alias("lang"), text.contains("e").alias("has_e"),
        F.substring("source", 1, 3).alias("head"),
        F.length(replace_first(text, "[aeiou]", "##")).alias("chars"),
        is_one_of(F.col("lang"), ["en", "de"]).alias("listed"),
        replace_first(F.col("source"), "[0-9]", "").alias("bare"),
        F.concat("source", F.lit(":"), "lang").alias("pasted"),
    )
    keys = [c for c in derived.columns if c != "chars"]
    return derived.groupBy(*keys).agg(F.sum("chars").alias("replaced_chars"), F.count("*").alias("n"))


@query("calendar_age", f"""
WITH {COHORT_SQL}, {AGE_SQL}
SELECT record_id, round(age_years, 6) AS age, year(date_of_birth)::INT AS birth_year FROM aged WHERE age_years IS NOT NULL""")
def calendar_age(spark, sf):
    aged = cohort(spark, sf).select("record_id", r6(clean.age_years()).alias("age"), F.year("date_of_birth").alias("birth_year"))
    return aged.filter(F.col("age").isNotNull())


@query("age_avail", f"""
WITH {COHORT_SQL}, {AGE_SQL}
SELECT CASE WHEN age_calculated IS NOT NULL THEN 'already calculated' WHEN age_years < -0.75 THEN 'implausible'
  WHEN age_years <= 0 THEN 'in utero?' WHEN age_years IS NOT NULL THEN 'birth & receipt dates'
  WHEN date_of_birth IS NOT NULL THEN 'birth date only' ELSE 'nothing' END AS age_avail, count(*) AS n
FROM aged GROUP BY 1""")
def age_avail(spark, sf):
    return cohort(spark, sf).groupBy(clean.age_class().alias("age_avail")).agg(F.count("*").alias("n"))


@query("age_guess", f"""
WITH {COHORT_SQL}, {AGE_SQL}, ref AS (
  SELECT *, 2009 - year(date_of_birth) - CASE WHEN CAST(date_of_birth + to_months(CAST(12 * (2009 - year(date_of_birth)) AS INT)) AS DATE)
     > DATE '2009-01-01' THEN 1 ELSE 0 END AS k FROM aged)
SELECT record_id, round(coalesce(age_calculated, age_years, k + (DATE '2009-01-01' - CAST(date_of_birth + to_months(CAST(12 * k AS INT)) AS DATE))
   / (CAST(date_of_birth + to_months(CAST(12 * (k + 1) AS INT)) AS DATE) - CAST(date_of_birth + to_months(CAST(12 * k AS INT)) AS DATE))::DOUBLE), 6) AS age_guess
FROM ref""")
def age_guess(spark, sf):
    return cohort(spark, sf).select("record_id", r6(clean.age_guess()).alias("age_guess"))


@query("smoking_classes", f"""
WITH {COHORT_SQL}, h AS (
  SELECT CASE WHEN smoking_history_cigarette IN ('None', 'Past', 'Current') THEN smoking_history_cigarette END AS hist FROM cohort)
SELECT hist, hist IN ('Past', 'Current') AS smoking_hx,
  CASE WHEN hist IN ('Past', 'Current') THEN hist WHEN hist IS NOT NULL THEN 'Never' END AS smoking_use, count(*) AS n
FROM h GROUP BY ALL""")
def smoking_classes(spark, sf):
    listed = keep_levels(F.col("smoking_history_cigarette"), ["None", "Past", "Current"])
    c = clean.with_smoking_classes(order_side(spark, sf).select(listed.alias("hist")), "hist")
    return c.groupBy("hist", "smoking_hx", "smoking_use").agg(F.count("*").alias("n"))


@query("pack_years", f"""
WITH {COHORT_SQL}
SELECT record_id, max_quantity * n_lines AS pack_years_current FROM cohort""")
def pack_years(spark, sf):
    c = cohort(spark, sf).withColumnsRenamed({
        "max_quantity": "packs_per_day_current", "n_lines": "for_how_many_years_current"})
    return clean.with_pack_years(c, ("current",)).select("record_id", "pack_years_current")


@query("guideline_flags", f"""
WITH {COHORT_SQL}
SELECT hx_bulk OR hx_many AS v1, hx_bulk OR hx_many OR hx_high_tax AS v2,
       hx_returned OR hx_deep_discount AS merged, count(*) AS n FROM cohort GROUP BY ALL""")
def guideline_flags(spark, sf):
    flags = cohort(spark, sf).select(
        guideline_v1().alias("v1"), guideline_v2().alias("v2"),
        any_true(F.col("hx_returned"), F.col("hx_deep_discount")).alias("merged"))
    return flags.groupBy("v1", "v2", "merged").agg(F.count("*").alias("n"))


@query("math_fns", """
SELECT l_quantity AS x, round_even(l_quantity / 2, 0)::INT AS half_even, abs(l_quantity - 25) AS dist,
  sign(l_quantity - 25)::INT AS side, round(exp(-l_quantity / 10), 6) AS decay, least(l_quantity, 20.0::DOUBLE) AS lower,
  greatest(l_quantity, 20.0::DOUBLE) AS upper, round(sqrt(l_quantity), 6) AS root, round(pow(10.0::DOUBLE, l_quantity / 50), 6) AS ten_to,
  floor(l_quantity / 7)::BIGINT AS whole, (l_quantity::INT % 7)::INT AS rest, len(range(1, l_quantity::INT + 1)) AS steps, count(*) AS n
FROM lineitem GROUP BY l_quantity""")
def math_fns(spark, sf):
    x = F.col("x")
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    return counts.select(
        "x", "n", F.bround(x / 2, 0).cast("int").alias("half_even"), F.abs(x - 25).alias("dist"),
        F.signum(x - 25).cast("int").alias("side"), r6(F.exp(-x / 10)).alias("decay"),
        F.least(x, F.lit(20.0)).alias("lower"), F.greatest(x, F.lit(20.0)).alias("upper"),
        r6(F.sqrt(x)).alias("root"), r6(F.pow(F.lit(10.0), x / 50)).alias("ten_to"),
        F.floor(x / 7).alias("whole"), F.pmod(x.cast("int"), F.lit(7)).alias("rest"),
        F.size(F.sequence(F.lit(1), x.cast("int"))).cast("long").alias("steps"),
    )


@query("format_pct", f"""
WITH {STUDY_SQL}, g AS (SELECT gender, count(*) AS n, avg(is_event::INT) AS share, min(hx_many::INT - 2 * hx_bulk::INT)::INT AS low FROM study GROUP BY gender)
SELECT gender, format('{{:,}}', n) AS amount, printf('%.2f', share * 100) || '%' AS share_text,
  format('{{:,}}', n) || ' (' || printf('%.1f', share * 100) || '%)' AS cell, replace(low::VARCHAR, '-', '–') AS low_text FROM g""")
def format_pct(spark, sf):
    low = F.min(F.col("hx_many").cast("int") - 2 * F.col("hx_bulk").cast("int"))
    g = study(spark, sf).groupBy("gender").agg(
        F.count("*").alias("n"), F.avg(F.col("is_event").cast("int")).alias("share"), low.alias("low"))
    amount = F.format_number("n", 0)
    return g.select(
        "gender", amount.alias("amount"), percent_text(F.col("share"), 2).alias("share_text"),
        F.concat(amount, F.lit(" ("), percent_text(F.col("share"), 1), F.lit(")")).alias("cell"),
        number_text(F.col("low")).alias("low_text"))


@query("levels_present", f"""
WITH {COHORT_SQL}, p AS (SELECT smoking_history_cigarette AS level, count(*) AS n FROM cohort WHERE genotype = 'ZZ' GROUP BY 1)
SELECT level, n, row_number() OVER (ORDER BY CASE level WHEN 'None' THEN 1 WHEN 'Passive Smoke as a Child' THEN 2
  WHEN 'Passive Smoke as am Adult' THEN 3 WHEN 'Past' THEN 4 ELSE 5 END)::INT AS level_no FROM p WHERE level IS NOT NULL""")
def level_list(spark, sf):
    c = order_side(spark, sf).filter("genotype = 'ZZ'")
    levels = levels_present(c, "smoking_history_cigarette", settings.SMOKING_LEVELS)
    counts = c.groupBy(F.col("smoking_history_cigarette").alias("level")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("level").isNotNull()).withColumn(
        "level_no", F.array_position(F.lit(levels), F.col("level")).cast("int"))


# ---- aggregates ------------------------------------------------------------


@query("count_by", f"""
WITH {COHORT_SQL}
SELECT smoking_history_cigarette, any_tobacco_exposure, count(*) AS n FROM cohort GROUP BY ALL""")
def count_by(spark, sf):
    return order_side(spark, sf).groupBy("smoking_history_cigarette", "any_tobacco_exposure").agg(
        F.count("*").alias("n"))


@query("count_of_counts", """
WITH c AS (SELECT event_type, user_id, count(*) AS count FROM events GROUP BY ALL)
SELECT event_type, count, count(*) AS n FROM c GROUP BY ALL""")
def count_of_counts(spark, sf):
    return report.count_of_counts(table(spark, sf, "events"), ["event_type", "user_id"], ["event_type"])


@query("distinct_then_count", """
SELECT l_returnflag, l_linenumber, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_suppkey FROM lineitem) GROUP BY ALL""")
def distinct_then_count(spark, sf):
    return report.distinct_then_count(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_suppkey"], ["l_returnflag", "l_linenumber"])


@query("missingness", f"""
WITH {COHORT_SQL}, r AS (SELECT avg((genotype IS NULL)::INT) AS genotype, avg((hx_bulk IS NULL)::INT) AS hx_bulk,
   avg((date_of_birth IS NULL)::INT) AS date_of_birth, avg((date_received IS NULL)::INT) AS date_received,
   avg((age_calculated IS NULL)::INT) AS age_calculated, avg((gender IS NULL)::INT) AS gender FROM cohort),
u AS (UNPIVOT r ON COLUMNS(*) INTO NAME variable VALUE share)
SELECT variable, round(share, 6) AS missing_share, printf('%.0f', round_even(share * 100, 0)) || '%' AS missing_text FROM u""")
def missingness(spark, sf):
    columns = ["genotype", "hx_bulk", "date_of_birth", "date_received", "age_calculated", "gender"]
    rates = clean.missingness(cohort(spark, sf), columns)
    text = F.concat(F.format_number(F.bround(F.col("missing_share") * 100, 0), 0), F.lit("%"))
    return rates.select("variable", r6("missing_share").alias("missing_share"), text.alias("missing_text"))


@query("date_summary", f"""
WITH {COHORT_SQL}, d AS (SELECT date_received - DATE '1970-01-01' AS day FROM cohort WHERE date_received IS NOT NULL)
SELECT DATE '1970-01-01' + min(day)::INT AS first, DATE '1970-01-01' + max(day)::INT AS last,
  DATE '1970-01-01' + floor(avg(day))::INT AS mean, DATE '1970-01-01' + floor(quantile_cont(day, 0.5))::INT AS median FROM d""")
def date_summary(spark, sf):
    return report.date_summary(cohort(spark, sf), "date_received")


@query("referent_profile", f"""
WITH {STUDY_SQL}
SELECT min(hx_returned::INT) AS hx_returned, min(hx_deep_discount::INT) AS hx_deep_discount, min(hx_bulk::INT) AS hx_bulk,
  min(hx_high_tax::INT) AS hx_high_tax, min(hx_many::INT) AS hx_many, min(n_lines) AS n_lines FROM study""")
def referent_profile(spark, sf):
    s = study(spark, sf)
    return s.agg(*[F.min(F.col(f).cast("int")).alias(f) for f in FLAGS], F.min("n_lines").alias("n_lines"))


# replicate metrics: two card families x terms x bound x folds, plus the guideline

_TERMS = {
    "C1": [("hx_returned", 3), ("hx_bulk", -2), ("hx_many", 5)],
    "C2": [("hx_deep_discount", 1), ("hx_high_tax", 2), ("hx_many", -1)],
}


def replicate_metrics(spark, sf):
    """Accuracy (class at score >= 2) and area under ROC per model, setting and fold."""
    s = resample.folds(
        settled(study(spark, sf).select("record_id", "is_event", "guideline", *FLAGS)), ["is_event"], "record_id")
    variants = [("guideline", None, None, F.col("guideline").cast("int") * 2)]
    for model, items in _TERMS.items():
        for terms in (1, 2, 3):
            for bound in (1, 2):
                total = sum((F.col(i).cast("int") * (p * bound) for i, p in items[:terms]), F.lit(0))
                variants.append((model, terms, bound, total))
    rows = F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(t).cast("int").alias("terms"), F.lit(b).cast("int").alias("bound"),
                 x.alias("score"))
        for m, t, b, x in variants
    ]))
    keys = ["model", "terms", "bound", "fold"]
    totals = threshold_totals(s.select("fold", "is_event", rows), keys)
    right = F.when(F.col("score") >= 2, F.col("pos")).otherwise(F.col("neg"))
    both = totals.groupBy(*keys).agg(
        ratio(F.sum(right), F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"), area().alias("roc_auc"))
    return long_metrics(both, keys, ["accuracy", "roc_auc"]).drop("estimator")


_variants_sql = " UNION ALL ".join(
    ["SELECT fold, is_event, 'guideline' AS model, NULL::INT AS terms, NULL::INT AS bound, 2 * guideline::INT AS score FROM folded"]
    + [
        f"SELECT fold, is_event, '{m}', {t}, {b}, " + " + ".join(f"({p * b}) * {i}::INT" for i, p in items[:t]) + " FROM folded"
        for m, items in _TERMS.items() for t in (1, 2, 3) for b in (1, 2)
    ]
)

FOLD_SQL = f"""
folded AS (
  SELECT *, ((row_number() OVER (PARTITION BY is_event ORDER BY md5('{settings.SEED}|' || record_id), record_id) - 1) % 6 + 1)::INT AS fold
  FROM study)"""

METRICS_SQL = STUDY_SQL + "," + FOLD_SQL + f""",
variants AS ({_variants_sql}),
vcounts AS (SELECT model, terms, bound, fold, score, sum(is_event::INT) AS pos, sum(1 - is_event::INT) AS neg FROM variants GROUP BY ALL),
vcum AS (SELECT *, sum(pos) OVER (PARTITION BY model, terms, bound, fold ORDER BY score DESC) - pos AS above FROM vcounts),
metrics AS (
  SELECT model, terms, bound, fold, 'accuracy' AS metric,
         sum(CASE WHEN score >= 2 THEN pos ELSE neg END)::DOUBLE / sum(pos + neg)::DOUBLE AS estimate
  FROM vcum GROUP BY ALL
  UNION ALL
  SELECT model, terms, bound, fold, 'roc_auc', sum(neg * (above + pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE
  FROM vcum GROUP BY ALL),
summary AS (
  SELECT model, terms, bound, metric, avg(estimate) AS mean, stddev_samp(estimate) AS sd, count(estimate) AS n
  FROM metrics GROUP BY ALL)"""


@query("cv_summary", f"""
WITH {METRICS_SQL}
SELECT model, terms, bound, metric, round(mean, 6) AS mean, round(sd, 6) AS sd FROM summary""")
def cv_summary(spark, sf):
    s = mean_interval(replicate_metrics(spark, sf), ["fold"])
    return s.select("model", "terms", "bound", "metric", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("cv_interval", f"""
WITH {METRICS_SQL}
SELECT model, terms, bound, metric, n, round(sd / sqrt(n), 6) AS se, round(mean - 2 * sd, 6) AS low, round(mean + 2 * sd, 6) AS high FROM summary""")
def cv_interval(spark, sf):
    s = mean_interval(replicate_metrics(spark, sf), ["fold"])
    return s.select("model", "terms", "bound", "metric", "n", *[r6(c).alias(c) for c in ("se", "low", "high")])


@query("cv_best", f"""
WITH {METRICS_SQL}, b AS (SELECT *, rank() OVER (PARTITION BY model, metric ORDER BY round(mean, 9) DESC) AS r FROM summary)
SELECT model, metric, terms, bound, round(mean, 6) AS mean FROM b WHERE r = 1""")
def cv_best(spark, sf):
    s = mean_interval(replicate_metrics(spark, sf), ["fold"])
    return best_settings(s, ["model", "metric"]).select("model", "metric", "terms", "bound", r6("mean").alias("mean"))


@query("cv_best_simplest", f"""
WITH {METRICS_SQL}, b AS (SELECT *, rank() OVER (PARTITION BY model, metric ORDER BY round(mean, 9) DESC, terms, bound) AS r FROM summary)
SELECT model, metric, terms, bound, round(mean, 6) AS mean FROM b WHERE r = 1""")
def cv_best_simplest(spark, sf):
    s = mean_interval(replicate_metrics(spark, sf), ["fold"])
    best = best_settings(s, ["model", "metric"], [F.col("terms").asc_nulls_last(), F.col("bound").asc_nulls_last()])
    return best.select("model", "metric", "terms", "bound", r6("mean").alias("mean"))


@query("class_shares", f"""
WITH {COHORT_SQL}, c AS (SELECT genotype, count(*) AS n FROM cohort WHERE genotype IN ('SZ', 'ZZ') GROUP BY genotype)
SELECT round(sum(CASE WHEN genotype = 'ZZ' THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE, 6) AS p_zz,
       round(sum(CASE WHEN genotype = 'SZ' THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE, 6) AS p_sz FROM c""")
def class_shares(spark, sf):
    counts = order_side(spark, sf).filter(F.col("genotype").isin("SZ", "ZZ")).groupBy("genotype").agg(
        F.count("*").alias("n"))
    part = lambda g: ratio(F.sum(F.when(F.col("genotype") == g, F.col("n")).otherwise(0)), F.sum("n"))
    return counts.agg(r6(part("ZZ")).alias("p_zz"), r6(part("SZ")).alias("p_sz"))


@query("prevalence", f"""
WITH {STUDY_SQL} SELECT round(avg(is_event::INT), 6) AS prevalence, count(*) AS n FROM study""")
def prevalence(spark, sf):
    return study(spark, sf).agg(
        r6(F.avg(F.col("is_event").cast("int"))).alias("prevalence"), F.count("*").alias("n"))


@query("histogram", """
WITH w AS (SELECT greatest(1.0::DOUBLE, (max(n_chars) - min(n_chars)) / 24.0::DOUBLE) AS width FROM documents)
SELECT floor(n_chars / (SELECT width FROM w))::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1""")
def histogram(spark, sf):
    docs = table(spark, sf, "documents").select("n_chars")
    return report.histogram(docs, "n_chars", report.spread_width(docs, "n_chars"))


@query("five_number", f"""
WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row, o_totalprice AS x FROM orders),
b AS (SELECT CASE WHEN row <= 5000 THEN '(0,5000]' WHEN row <= 12000 THEN '(5000,12000]' ELSE '(12000,Inf]' END AS batch, x FROM o)
SELECT batch, round(min(x), 6) AS q0, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2,
  round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS q4 FROM b GROUP BY batch""")
def five_number(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    batched = clean.in_batches(o, "o_orderkey", [5000, 12000])
    q = report.five_number(batched, ["batch"], "o_totalprice")
    return q.select("batch", *[r6(c).alias(c) for c in report.QUARTILES])


# ---- windows ---------------------------------------------------------------


@query("row_index", """
SELECT o_orderkey AS record_id, row_number() OVER (ORDER BY o_orderkey) AS row FROM orders""")
def row_index(spark, sf):
    return numbered(order_side(spark, sf).select("record_id"), "record_id")


@query("islands", f"""
WITH {COHORT_SQL}, k AS (SELECT record_id FROM cohort WHERE age_calculated IS NULL AND date_of_birth IS NOT NULL AND date_received IS NOT NULL),
g AS (SELECT record_id, record_id - row_number() OVER (ORDER BY record_id) AS grp FROM k),
r AS (SELECT min(record_id) AS first_key, max(record_id) AS last_key, count(*) AS n_rows FROM g GROUP BY grp)
SELECT *, row_number() OVER (ORDER BY first_key) AS island FROM r""")
def islands(spark, sf):
    c = cohort(spark, sf).filter(F.col("age_calculated").isNull()).dropna(subset=["date_of_birth", "date_received"])
    return clean.islands(c, "record_id")


@query("screen_fraction", f"""
WITH {SCORED_SQL}, c AS (SELECT card, score, count(*) AS n FROM scored GROUP BY ALL)
SELECT card, score, n, round(sum(n) OVER (PARTITION BY card ORDER BY score DESC)::DOUBLE / sum(n) OVER (PARTITION BY card)::DOUBLE, 6) AS screen FROM c""")
def screen_fraction(spark, sf):
    share = screened_share(score_records(study(spark, sf), CARDS, []), ["card"])
    return share.withColumn("screen", r6("screen"))


@query("replicate_no", f"""
WITH {METRICS_SQL}
SELECT model, terms, bound, metric, ((row_number() OVER (PARTITION BY model, metric ORDER BY terms, bound) - 1) % 2 + 1)::INT AS number FROM summary""")
def replicate_no(spark, sf):
    s = mean_interval(replicate_metrics(spark, sf), ["fold"]).select("model", "terms", "bound", "metric")
    return report.renumbered(s, ["model", "metric"], [F.col("terms"), F.col("bound")], 2)


@query("shift_min_zero", f"""
WITH {SCORED_SQL}, c AS (SELECT card, score, count(*) AS n FROM scored GROUP BY ALL)
SELECT card, score, n, (score - min(score) OVER (PARTITION BY card))::INT AS shifted FROM c""")
def shift_min_zero(spark, sf):
    counts = score_records(study(spark, sf), CARDS, []).groupBy("card", "score").agg(F.count("*").alias("n"))
    return report.shifted_to_zero(counts, ["card"], "score", "shifted")


@query("first_appearance", """
WITH f AS (SELECT event_type, min(event_id) AS first_at FROM events GROUP BY event_type)
SELECT event_type, first_at, row_number() OVER (ORDER BY first_at)::INT AS level_no FROM f""")
def first_appearance(spark, sf):
    return clean.first_seen_order(table(spark, sf, "events"), "event_type", "event_id")


@query("cut_batches", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row FROM orders)
SELECT CASE WHEN row <= 5000 THEN '(0,5000]' WHEN row <= 12000 THEN '(5000,12000]' ELSE '(12000,Inf]' END AS batch,
  count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM o GROUP BY 1""")
def cut_batches(spark, sf):
    rows = numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return rows.groupBy(clean.batch_label(F.col("row"), [5000, 12000]).alias("batch")).agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


# ---- sorts and samples -----------------------------------------------------


@query("arrange_nulls_last", f"""
WITH {COHORT_SQL}
SELECT genotype, gender, count(*) AS n FROM cohort GROUP BY ALL ORDER BY genotype DESC NULLS LAST, gender NULLS LAST""")
def arrange_nulls_last(spark, sf):
    counts = order_side(spark, sf).groupBy("genotype", "gender").agg(F.count("*").alias("n"))
    return report.sorted_nulls_last(counts, ("genotype", True), ("gender", False))


_taken = lambda strata, rule: f"""
WITH {COHORT_SQL}, s AS (SELECT record_id, genotype, CASE WHEN genotype IN ('SZ', 'ZZ', 'MM') THEN genotype ELSE 'Ab' END AS stratum,
    any_tobacco_exposure FROM cohort),
p AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS pos,
             count(*) OVER (PARTITION BY {strata}) AS n FROM s)
SELECT record_id, genotype FROM p WHERE pos <= {rule}"""


@query("stratified_sample", _taken("stratum", "floor(n * (1 / 6.0::DOUBLE / 0.8::DOUBLE))"))
def stratified_sample(spark, sf):
    s = order_side(spark, sf).select("record_id", "genotype", resample.genotype_stratum().alias("stratum"))
    share = settings.SUBSET_FRACTION / settings.TRAIN_FRACTION
    return resample.stratified_sample(s, ["stratum"], "record_id", share).drop("stratum")


@query("sample_per_cell", _taken("genotype, any_tobacco_exposure", "4"))
def sample_per_cell(spark, sf):
    s = order_side(spark, sf).select("record_id", "genotype", "any_tobacco_exposure")
    return resample.sample_each(s, ["genotype", "any_tobacco_exposure"], "record_id", 4).drop("any_tobacco_exposure")


@query("sample_frac", _taken("1", "floor(n * 0.1::DOUBLE)"))
def sample_frac(spark, sf):
    return resample.sample_fraction(order_side(spark, sf).select("record_id", "genotype"), "record_id", 0.1)


# ---- set operations and reshaping -------------------------------------------


@query("union_metrics", f"""
WITH {METRICS_SQL}
SELECT model, metric, terms, NULL::INT AS bound, count(*) AS n, 1 AS number FROM metrics WHERE model = 'C1' GROUP BY ALL
UNION ALL
SELECT model, metric, NULL::INT, bound, count(*), NULL::INT FROM metrics WHERE model = 'C2' GROUP BY ALL""")
def union_metrics(spark, sf):
    m = replicate_metrics(spark, sf)
    first = m.filter("model = 'C1'").groupBy("model", "metric", "terms").agg(F.count("*").alias("n")).withColumn(
        "number", F.lit(1))
    second = m.filter("model = 'C2'").groupBy("model", "metric", "bound").agg(F.count("*").alias("n"))
    return first.unionByName(second, allowMissingColumns=True)


@query("dedupe_models", f"""
WITH {STUDY_SQL}
SELECT 'guideline' AS model, 'ZZ' AS response, sum((guideline AND is_event)::INT)::BIGINT AS tp, sum((guideline AND NOT is_event)::INT)::BIGINT AS fp FROM study""")
def dedupe_models(spark, sf):
    """The guideline row is stored once per predictor set and must count once."""
    perf = screen_performance(study(spark, sf), F.col("guideline"), F.col("is_event")).select(
        F.lit("guideline").alias("model"), F.lit("ZZ").alias("response"), "tp", "fp")
    stored = perf.withColumn("predictors", F.explode(F.array(F.lit("Dx"), F.lit("Dx+smoking"))))
    return stored.dropDuplicates(["model", "response"]).drop("predictors")


@query("confusion_wide", f"""
WITH {SCORED_SQL}
SELECT card, sum((score >= 1 AND is_event)::INT)::BIGINT AS "TP", sum((score < 1 AND NOT is_event)::INT)::BIGINT AS "TN",
  sum((score >= 1 AND NOT is_event)::INT)::BIGINT AS "FP", sum((score < 1 AND is_event)::INT)::BIGINT AS "FN" FROM scored GROUP BY card""")
def confusion_wide(spark, sf):
    screen, test = F.col("score") >= 1, F.col("is_event")
    quadrant = F.when(screen & test, "TP").when(~screen & ~test, "TN").when(screen & ~test, "FP").otherwise("FN")
    scored = score_records(study(spark, sf), CARDS, ["is_event"])
    counts = scored.groupBy("card", quadrant.alias("quadrant")).agg(F.count("*").alias("n"))
    names = ["TP", "TN", "FP", "FN"]
    return counts.groupBy("card").pivot("quadrant", names).agg(F.sum("n")).fillna(0, names)


@query("cases_by_score", f"""
WITH {SCORED_SQL}
SELECT card, score, sum((NOT is_event)::INT)::BIGINT AS "Normal", sum(is_event::INT)::BIGINT AS "Abnormal" FROM scored GROUP BY ALL""")
def cases_by_score(spark, sf):
    truth = if_else(F.col("is_event"), F.lit("Abnormal"), F.lit("Normal"))
    scored = score_records(study(spark, sf), CARDS, ["is_event"]).withColumn("truth", truth)
    counts = scored.groupBy("card", "score", "truth").agg(F.count("*").alias("n"))
    return counts.groupBy("card", "score").pivot("truth", ["Normal", "Abnormal"]).agg(F.sum("n")).fillna(
        0, ["Normal", "Abnormal"])


@query("unpivot_items", f"""
WITH {STUDY_SQL}
UNPIVOT (SELECT record_id, hx_returned::INT AS hx_returned, hx_deep_discount::INT AS hx_deep_discount, hx_bulk::INT AS hx_bulk,
  hx_high_tax::INT AS hx_high_tax, hx_many::INT AS hx_many FROM study)
ON hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many INTO NAME item VALUE value""")
def unpivot_items(spark, sf):
    return report.unpivot_flags(study(spark, sf), ["record_id"], FLAGS)


@query("nest_unnest", f"""
WITH {METRICS_SQL} SELECT model, fold, metric, round(estimate, 6) AS estimate FROM metrics""")
def nest_unnest(spark, sf):
    """Metrics nested per model and fold (a handful each), then flat again."""
    m = replicate_metrics(spark, sf)
    nested = m.groupBy("model", "fold").agg(F.collect_list(F.struct("metric", "estimate")).alias("metrics"))
    flat = nested.select("model", "fold", F.inline_outer("metrics"))
    return flat.withColumn("estimate", r6("estimate"))


@query("map_explode", f"""
WITH {SCORED_SQL}, c AS (SELECT card, score, count(*) AS n FROM scored GROUP BY ALL)
SELECT card, score::VARCHAR AS name, n AS value FROM c""")
def map_explode(spark, sf):
    """Score -> count as one map per card and back to rows; a card has few scores."""
    counts = score_records(study(spark, sf), CARDS, []).groupBy("card", "score").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("score").cast("string"), F.col("n"))
    maps = counts.groupBy("card").agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))
    return maps.select("card", F.explode("counts").alias("name", "value"))


@query("unite_cols", f"""
WITH {COHORT_SQL}
SELECT coalesce(genotype, 'NA') || ' -> ' || coalesce(gender, 'NA') AS specification, count(*) AS n FROM cohort GROUP BY 1""")
def unite_cols(spark, sf):
    text = joined_text(" -> ", F.col("genotype"), F.col("gender"))
    return order_side(spark, sf).groupBy(text.alias("specification")).agg(F.count("*").alias("n"))


@query("spec_text", f"""
WITH {METRICS_SQL}
SELECT model, metric, concat_ws(', ', 'terms = ' || terms, 'bound = ' || bound) AS specification, n FROM summary""")
def spec_text(spark, sf):
    s = mean_interval(replicate_metrics(spark, sf), ["fold"])
    text = setting_text(terms=F.col("terms"), bound=F.col("bound"))
    return s.select("model", "metric", text.alias("specification"), "n")


@query("gain_summary", f"""
WITH {SCORED_SQL}, g AS (SELECT s.card, c.gender, s.score, s.is_event FROM scored s JOIN cohort c USING (record_id)),
c AS (SELECT card, gender, score, sum(is_event::INT) AS pos, sum(1 - is_event::INT) AS neg FROM g GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY card, gender) AS p, sum(neg) OVER (PARTITION BY card, gender) AS q
      FROM c WINDOW w AS (PARTITION BY card, gender ORDER BY score DESC)),
k AS (SELECT card, gender, score, tp::DOUBLE / p::DOUBLE - fp::DOUBLE / q::DOUBLE AS gain FROM t),
peak AS (SELECT card, gender, max(gain) AS peak FROM k GROUP BY ALL)
SELECT card, round(min(peak), 6) AS least_peak_gain, round(max(peak), 6) AS greatest_peak_gain FROM peak GROUP BY card""")
def gain_summary(spark, sf):
    scored = score_records(study(spark, sf), CARDS, ["gender", "is_event"])
    points = roc_points(threshold_totals(scored, ["card", "gender"]), ["card", "gender"])
    out = peak_gains(points, "card", ["gender"])
    return out.select("card", r6("least_peak_gain").alias("least_peak_gain"), r6("greatest_peak_gain").alias("greatest_peak_gain"))


