"""Fitted models and what can be checked about them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.values import class_label
from tallycard.models import batch_fit, card_search, conditional, forests, guideline, knn, lda, linear, svm, trees
from tallycard.models import svm_gap as svm_certificate
from tallycard.operators import cards as card_ops
from tallycard.operators import clean, resample
from tallycard.operators.encode import patterns, weighted_rows
from tallycard.plans.tuning import ridge_cv
from tallycard.registry.base import query, r6
from tallycard.registry.summaries import AGE_SQL, FOLD_SQL
from tallycard.session import settled
from tallycard.sources.fixtures import CARDS, COHORT_SQL, FLAGS, STUDY_SQL, cohort, study


def train_test(spark, sf):
    """The study table is written once: splitting looks at it several times."""
    s = settled(study(spark, sf).select("record_id", "is_event", "gender", "guideline", *FLAGS))
    return resample.split(s, ["is_event"], "record_id", settings.TRAIN_FRACTION)


TT_SQL = STUDY_SQL + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY is_event ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS pos,
           count(*) OVER (PARTITION BY is_event) AS n_stratum FROM study),
tt AS (SELECT *, CASE WHEN pos <= floor(n_stratum * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM placed)"""


def pattern_sets(spark, sf):
    """Patterns of the training and of the test rows, from one pass over the records."""
    both = settled(patterns(train_test(spark, sf), FLAGS, keys=["split"]))
    as_int = {f: F.col(f).cast("int") for f in FLAGS}
    side = lambda s: both.filter(F.col("split") == s).drop("split").withColumns(as_int)
    return side("train"), side("test")


KEEP = [*FLAGS, "pos", "n"]


def _fit_rows(spark, sf):
    train, test = pattern_sets(spark, sf)
    return weighted_rows(train, FLAGS), test


TERMS = ["", *FLAGS]  # the empty name is the intercept
EVENTS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS item, sum(is_event::INT{' * ' + f + '::INT' if f else ''})::DOUBLE AS total FROM {{t}}" for f in TERMS)


def fitted_totals(pats, p_event, keys=()):
    """Sum of the fitted shares over all rows, and over the rows with each item: what a fit must have in common with the events."""
    weight = F.col("n") * p_event
    cells = F.inline(F.array(*[
        F.struct(F.lit(f).alias("item"), (weight * F.col(f) if f else weight).cast("double").alias("x")) for f in TERMS]))
    return pats.select(*keys, cells).groupBy(*keys, "item").agg(F.sum("x").alias("total"))


@query("lr_fit", f"WITH {TT_SQL}, train AS (SELECT * FROM tt WHERE split = 'train') " + EVENTS_SQL.format(t="train"))
def lr_fit(spark, sf):
    """At the optimum the fitted shares of every item's rows add up to the observed events."""
    train, _ = pattern_sets(spark, sf)
    fit = linear.fit_logistic(weighted_rows(train, FLAGS), FLAGS)
    return fitted_totals(train, fit.p_event()).withColumn("total", F.round("total", 2) + 0.0)


@query("lr_pred")
def lr_pred(spark, sf):
    train, test = pattern_sets(spark, sf)
    fit = linear.fit_logistic(weighted_rows(train, FLAGS), FLAGS)
    return linear.classed(test, KEEP, fit.p_event())


def ridge_fits(spark, sf):
    s = settled(study(spark, sf).select("record_id", "is_event", *FLAGS))
    pats = settled(patterns(resample.folds(s, ["is_event"], "record_id"), FLAGS, keys=["fold"]))
    return pats.withColumns({f: F.col(f).cast("int") for f in FLAGS})


@query("lr_ridge", f"WITH {STUDY_SQL}, {FOLD_SQL}, k AS (SELECT DISTINCT fold AS left_out FROM folded), "
       f"p AS (SELECT unnest({settings.PENALTIES}::DOUBLE[]) AS penalty), "
       "train AS (SELECT * FROM folded, k, p WHERE fold <> left_out) "
       + " UNION ALL ".join(f"SELECT left_out, penalty, '{f}' AS item, sum(is_event::INT{' * ' + f + '::INT' if f else ''})::DOUBLE AS total "
                            "FROM train GROUP BY ALL" for f in TERMS))
def lr_ridge(spark, sf):
    """Every penalty on every fold, fitted together; fitted events plus the pull of the penalty are the observed events."""
    pats = ridge_fits(spark, sf)
    folds = range(1, settings.N_FOLDS + 1)
    specs = [batch_fit.FitSpec(f"{p!r}|{k}", tuple(FLAGS), p, k) for p in settings.PENALTIES for k in folds]
    fits = batch_fit.fit_many(pats, specs)
    train = pats.withColumn("left_out", F.explode(F.lit(list(folds)))).filter("fold <> left_out")
    x = {f: F.col("n") * F.col(f) for f in FLAGS}
    moments = train.groupBy("left_out").agg(F.sum("n").alias("rows"), *[F.sum(x[f]).alias(f) for f in FLAGS])
    parts = []
    for p in settings.PENALTIES:
        share, pull = F.lit(None).cast("double"), F.lit(0.0)
        for k in folds:
            fit = fits[f"{p!r}|{k}"]
            share = F.when(F.col("left_out") == k, fit.p_event()).otherwise(share)
            for f in FLAGS:
                # n * penalty * variance * coefficient; a 0/1 item's variance follows from its count
                spread = F.col(f) * (1 - F.col(f) / F.col("rows")) / (F.col("rows") - 1)
                pull = F.when((F.col("left_out") == k) & (F.col("item") == f), F.col("rows") * p * spread * fit.coefs[f]).otherwise(pull)
        totals = fitted_totals(train, share, ["left_out"]).join(F.broadcast(moments), "left_out")
        parts.append(totals.select("left_out", F.lit(p).alias("penalty"), "item", (F.round(F.col("total") + pull, 2) + 0.0).alias("total")))
    return reduce(DataFrame.unionByName, parts)


@query("lr_ridge_metrics")
def lr_ridge_metrics(spark, sf):
    """Cross-validated metrics of every penalty, all folds and penalties fitted together."""
    return ridge_cv(ridge_fits(spark, sf), FLAGS, settings.PENALTIES, settings.N_FOLDS)


_products = [(a, b) for i, a in enumerate(FLAGS) for b in FLAGS[i:]]


@query("lda_moments", f"WITH {STUDY_SQL} " + " UNION ALL ".join(
    ["SELECT is_event, '' AS a, '' AS b, count(*)::DOUBLE AS total FROM study GROUP BY is_event"]
    + [f"SELECT is_event, '{a}', '', sum({a}::INT)::DOUBLE FROM study GROUP BY is_event" for a in FLAGS]
    + [f"SELECT is_event, '{a}', '{b}', sum({a}::INT * {b}::INT)::DOUBLE FROM study GROUP BY is_event" for a, b in _products]))
def lda_moments(spark, sf):
    s = study(spark, sf)
    return lda.lda_moments(s.withColumns({f: F.col(f).cast("int") for f in FLAGS}), FLAGS)


@query("lda_fit", f"WITH {TT_SQL}, train AS (SELECT * FROM tt WHERE split = 'train') " + " UNION ALL ".join(
    f"SELECT '{f}' AS item, round(avg({f}::INT) FILTER (is_event) - avg({f}::INT) FILTER (NOT is_event), 6) AS difference FROM train" for f in FLAGS))
def lda_fit(spark, sf):
    """The pooled covariance times the weights is the difference of the class means."""
    train = train_test(spark, sf).filter("split = 'train'").withColumns({f: F.col(f).cast("int") for f in FLAGS})
    moments = settled(lda.lda_moments(train, FLAGS))
    fit = lda.fit_lda(moments, FLAGS)
    wide = moments.filter("a <> ''").groupBy("is_event", "a").pivot("b", ["", *FLAGS]).agg(F.first("total")).withColumnRenamed("", "s")
    sizes = moments.filter("a = ''").select("is_event", F.col("total").alias("size"))
    # within-class cross products of two items, from the stored half of the symmetric table
    products = moments.filter("b <> ''")
    both = products.unionByName(products.filter("a <> b").select("is_event", F.col("b").alias("a"), F.col("a").alias("b"), "total"))
    sums = wide.select("is_event", "a", "s")
    within = both.join(sums.select("is_event", "a", F.col("s").alias("sa")), ["is_event", "a"]).join(
        sums.select("is_event", F.col("a").alias("b"), F.col("s").alias("sb")), ["is_event", "b"]).join(sizes, "is_event")
    weight = F.create_map(*[F.lit(x) for kv in fit.coefs.items() for x in kv])
    cell = (F.col("total") - F.col("sa") * F.col("sb") / F.col("size")) * F.element_at(weight, F.col("b"))
    total = sizes.agg(F.sum("size") - 2).scalar()
    return within.groupBy(F.col("a").alias("item")).agg((F.sum(cell) / F.first(total)).alias("difference")).withColumn("difference", r6("difference"))


@query("lda_pred")
def lda_pred(spark, sf):
    train = train_test(spark, sf).withColumns({f: F.col(f).cast("int") for f in FLAGS})
    fit = lda.fit_lda(lda.lda_moments(train.filter("split = 'train'"), FLAGS), FLAGS)
    return linear.classed(train.filter("split = 'test'"), ["record_id", "is_event"], fit.p_event())


GAIN_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS item, count(*) FILTER (NOT {f}) AS n_low, count(*) FILTER ({f}) AS n_high, "
    f"sum(is_event::INT) FILTER (NOT {f})::BIGINT AS events_low, sum(is_event::INT) FILTER ({f})::BIGINT AS events_high FROM train" for f in FLAGS)


@query("tree_rules", f"""
WITH {TT_SQL}, train AS (SELECT * FROM tt WHERE split = 'train'), s AS ({GAIN_SQL})
SELECT * FROM s ORDER BY events_low::DOUBLE * events_low / n_low + events_high::DOUBLE * events_high / n_high DESC LIMIT 1""")
def tree_rules(spark, sf):
    """First split of the rules, which must be the one of greatest gini gain, with its rows and events counted rule by rule."""
    train, _ = pattern_sets(spark, sf)
    rules = trees.rule_conditions(trees.fit_tree(weighted_rows(train, FLAGS), FLAGS, depth=None), FLAGS)
    table = trees.rule_table(train, rules)
    sides = F.lit([c[0][1] for c in rules])
    low = F.element_at(sides, F.col("rule_id")) == "<="
    on = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0))
    return table.agg(
        F.lit(rules[0][0][0]).alias("item"), on("n", low).alias("n_low"), on("n", ~low).alias("n_high"),
        on("events", low).alias("events_low"), on("events", ~low).alias("events_high"))


@query("tree_rule_table")
def tree_rule_table(spark, sf):
    train, _ = pattern_sets(spark, sf)
    model = trees.fit_tree(weighted_rows(train, FLAGS), FLAGS, depth=None)
    return trees.rule_table(train, trees.rule_conditions(model, FLAGS))


SHARE_SQL = f"""
WITH {TT_SQL}
SELECT {', '.join(f + '::INT AS ' + f for f in FLAGS)}, sum(is_event::INT)::BIGINT AS pos, count(*) AS n, round(avg(is_event::INT), 6) AS p_event
FROM tt WHERE split = 'train' GROUP BY {', '.join(FLAGS)}"""


def shares(pred):
    return pred.select(*[F.col(f).cast("int").alias(f) for f in FLAGS], "pos", "n", r6("p_event").alias("p_event"))


@query("dt_fit", SHARE_SQL)
def dt_fit(spark, sf):
    """With as many levels as items the tree gives every training pattern its own share."""
    train, _ = pattern_sets(spark, sf)
    model = trees.fit_tree(weighted_rows(train, FLAGS), FLAGS, depth=7)
    return shares(trees.predicted(model, train, FLAGS, KEEP))


@query("dt_pred")
def dt_pred(spark, sf):
    rows, test = _fit_rows(spark, sf)
    return trees.predicted(trees.fit_tree(rows, FLAGS, depth=7), test, FLAGS, KEEP)


def forest_rows(spark, sf):
    return train_test(spark, sf).select(
        "record_id", "is_event", "split", F.col("is_event").cast("double").alias("label"),
        *[F.col(f).cast("int").alias(f) for f in FLAGS])


@query("rf_exact", SHARE_SQL)
def rf_exact(spark, sf):
    """Without resampling and with all items at every split, each tree of the forest is the full tree."""
    s = forest_rows(spark, sf)
    train = s.filter("split = 'train'")
    model = trees.fit_forest(train, FLAGS, trees=3, mtry=len(FLAGS), bootstrap=False)
    return shares(trees.predicted(model, patterns(train, FLAGS), FLAGS, KEEP))


def forest_sql(n_trees: int, mtry: int) -> str:
    """The whole growing of one forest, level by level: bootstrap, sums, best split, next level."""
    p = len(FLAGS)
    sums = ", ".join(f"sum(n) FILTER (substr(code, {k + 1}, 1) = '1') AS n{k}, sum(pos) FILTER (substr(code, {k + 1}, 1) = '1') AS pos{k}" for k in range(p))
    parts = [f"""rec AS (SELECT record_id, is_event, is_event::INT AS event, split, {' || '.join(f + '::INT::VARCHAR' for f in FLAGS)} AS code FROM tt),
trees AS (SELECT unnest(range(1, {n_trees} + 1)) AS tree),
hashed AS (SELECT *, substr(md5('1|' || tree || '|' || record_id), 1, 8) AS h FROM rec, trees WHERE split = 'train'),
drawn AS (SELECT tree, code, event, {' + '.join(f"(h >= '{t}')::INT" for t in forests.STEPS)} AS w FROM hashed),
a0 AS (SELECT tree, code, sum(w)::BIGINT AS n, sum(w * event)::BIGINT AS pos, '' AS path FROM (
  SELECT tree, code, event, w FROM drawn UNION ALL SELECT tree, code, 0, 0 FROM (SELECT DISTINCT code FROM rec WHERE split = 'test'), trees) GROUP BY tree, code)"""]
    for level in range(p + 1):
        sides = " UNION ALL ".join(
            f"SELECT tree, path, n, pos, {k} AS idx, coalesce(n{k}, 0) AS n1, coalesce(pos{k}, 0) AS pos1, md5('1|1|' || tree || '|' || path || '|{f}') AS draw FROM t{level}" for k, f in enumerate(FLAGS))
        parts.append(f"""t{level} AS (SELECT tree, path, sum(n) AS n, sum(pos) AS pos, {sums} FROM a{level} GROUP BY tree, path),
c{level} AS (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY draw) AS r FROM ({sides})),
b{level} AS (SELECT tree, path, idx, n1, pos1 FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY
    pos1::DOUBLE * pos1 / n1 + (pos - pos1)::DOUBLE * (pos - pos1) / (n - n1) DESC, idx) AS k FROM c{level}
  WHERE r <= {mtry} AND n >= 2 AND n1 > 0 AND n1 < n AND pos1 * (n - n1) <> (pos - pos1) * n1) WHERE k = 1),
s{level} AS (SELECT tree, path, t{level}.n::BIGINT AS n, t{level}.pos::BIGINT AS pos, idx, b{level}.n1::BIGINT AS n_high, b{level}.pos1::BIGINT AS pos_high FROM t{level} LEFT JOIN b{level} USING (tree, path)),
a{level + 1} AS (SELECT tree, code, n, pos, path || idx || CASE WHEN substr(code, idx + 1, 1) = '1' THEN '>' ELSE '<' END AS path FROM a{level} JOIN b{level} USING (tree, path)),
e{level} AS (SELECT tree, code, s.pos::DOUBLE / nullif(s.n, 0) AS share FROM a{level} a JOIN s{level} s USING (tree, path) WHERE s.idx IS NULL)""")
    every = lambda name: " UNION ALL ".join(f"SELECT * FROM {name}{level}" for level in range(p + 1))
    return ",\n".join(parts) + f",\nnodes AS ({every('s')}),\nleaves AS ({every('e')})"


def one_forest(spark, sf, n_trees, mtry):
    s = settled(forest_rows(spark, sf))
    test = s.filter("split = 'test'")
    return forests.grow_forests(s.filter("split = 'train'"), FLAGS, [forests.Family(1, mtry)], n_trees, asked=test), test


@query("forest_splits", f"""
WITH {TT_SQL}, {forest_sql(3, 2)}
SELECT tree::INT AS tree, path, n, pos, list_extract({FLAGS}, idx + 1) AS feature, n_high, pos_high FROM nodes""")
def forest_splits(spark, sf):
    """Every node of a small forest; each split is the best of the features its node looks at."""
    grown, _ = one_forest(spark, sf, 3, 2)
    return grown.nodes.select("tree", "path", "n", "pos", "feature", "n_high", "pos_high")


@query("rf_fit", f"""
WITH {TT_SQL}, {forest_sql(120, 4)}, shares AS (SELECT code, sum(share) / count(share) AS p FROM leaves GROUP BY code)
SELECT record_id, is_event, round(p, 6) + 0.0 AS p_event, CASE WHEN p >= 0.5 THEN 'Abnormal' ELSE 'Normal' END AS pred_class
FROM rec JOIN shares USING (code) WHERE split = 'test'""")
def rf_fit(spark, sf):
    """A forest's shares and classes for the test records."""
    grown, test = one_forest(spark, sf, 120, 4)
    shares = settled(forests.forest_shares(grown.leaves, [120]).select("code", "p_event"))
    pred = test.withColumn("code", knn.bit_code(FLAGS)).join(shares, "code")
    return linear.classed(pred, ["record_id", "is_event"], F.col("p_event")).withColumn("p_event", r6("p_event"))


CALIBRATED_SQL = f"WITH {TT_SQL} SELECT count(*) AS n, sum(is_event::INT)::DOUBLE AS events FROM tt WHERE split = 'train'"


def calibrated_total(spark, sf, fitted):
    """The calibrated shares of all training rows add up to the observed events."""
    train, _ = pattern_sets(spark, sf)
    pred = fitted(weighted_rows(train, FLAGS)).predict(train, ["n"])
    return pred.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("p_event")), 2).alias("events"))


@query("svm_linear", CALIBRATED_SQL)
def svm_linear(spark, sf):
    return calibrated_total(spark, sf, lambda rows: svm.fit_svm_linear(rows, FLAGS))


@query("svm_poly2", CALIBRATED_SQL)
def svm_poly2(spark, sf):
    return calibrated_total(spark, sf, lambda rows: svm.fit_svm_poly(rows, FLAGS, 2))


@query("svm_poly3", CALIBRATED_SQL)
def svm_poly3(spark, sf):
    return calibrated_total(spark, sf, lambda rows: svm.fit_svm_poly(rows, FLAGS, 3))


#: A machine counts as the best one when no other can be better by more than this.
CLOSE = 0.002


@query("svm_gap", f"WITH {TT_SQL} SELECT unnest([1, 2, 3]) AS degree, count(*) AS n, sum(is_event::INT)::BIGINT AS events, true AS bounded, true AS best FROM tt WHERE split = 'train'")
def svm_gap(spark, sf):
    """For each degree: is the multipliers' bound below the fitted machine, and does it prove the polished one the best?"""
    train, _ = pattern_sets(spark, sf)
    rows = settled(weighted_rows(train, FLAGS))
    fits = {1: svm.fit_svm_linear(rows, FLAGS), 2: svm.fit_svm_poly(rows, FLAGS, 2), 3: svm.fit_svm_poly(rows, FLAGS, 3)}
    gaps = {d: svm_certificate.svm_gap(rows, fit) for d, fit in fits.items()}
    facts = spark.createDataFrame([(d, g.dual <= g.primal + 1e-9, g.polished - g.dual <= CLOSE) for d, g in gaps.items()], "degree int, bounded boolean, best boolean")
    counts = train.agg(F.sum("n").alias("n"), F.sum("pos").alias("events"))
    return facts.withColumns({"n": counts.select("n").scalar(), "events": counts.select("events").scalar()})


def svm_predictions(spark, sf, fitted):
    """Every test pattern with its counts, calibrated share and class."""
    rows, test = _fit_rows(spark, sf)
    return fitted(rows).predict(test, KEEP)


@query("svm_linear_pred")
def svm_linear_pred(spark, sf):
    return svm_predictions(spark, sf, lambda rows: svm.fit_svm_linear(rows, FLAGS))


@query("svm_poly2_pred")
def svm_poly2_pred(spark, sf):
    return svm_predictions(spark, sf, lambda rows: svm.fit_svm_poly(rows, FLAGS, 2))


@query("svm_poly3_pred")
def svm_poly3_pred(spark, sf):
    return svm_predictions(spark, sf, lambda rows: svm.fit_svm_poly(rows, FLAGS, 3))


_dist = " + ".join(f"(a.{f} <> b.{f})::INT" for f in FLAGS)


@query("knn_hamming", f"""
WITH {TT_SQL},
tr AS (SELECT {', '.join(FLAGS)}, sum(is_event::INT) AS pos, count(*) AS n FROM tt WHERE split = 'train' GROUP BY ALL),
te AS (SELECT {', '.join(FLAGS)}, sum(is_event::INT) AS pos, count(*) AS n FROM tt WHERE split = 'test' GROUP BY ALL),
d AS (SELECT {', '.join('a.' + f for f in FLAGS)}, a.n AS tn, a.pos AS tpos, {_dist} AS distance, sum(b.n) AS n, sum(b.pos) AS pos FROM te a, tr b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {', '.join(FLAGS)} ORDER BY distance) AS upto FROM d),
e AS (SELECT *, coalesce(min(CASE WHEN upto >= 361 THEN distance END) OVER (PARTITION BY {', '.join(FLAGS)}),
     max(distance) OVER (PARTITION BY {', '.join(FLAGS)}) + 1) AS edge,
     greatest(0, least(n, 360 - (upto - n))) AS taken FROM c),
w AS (SELECT *, taken * (1 - distance / (edge + 1e-6::DOUBLE)) AS mass, taken::DOUBLE AS flat FROM e WHERE taken > 0)
SELECT {', '.join(f + '::INT AS ' + f for f in FLAGS)}, tn::BIGINT AS n, tpos::BIGINT AS pos, round(sum(mass * pos / n) / sum(mass), 6) AS triangular,
       round(sum(flat * pos / n) / sum(flat), 6) AS rectangular
FROM w GROUP BY {', '.join(FLAGS)}, tn, tpos""")
def knn_hamming(spark, sf):
    train, test = pattern_sets(spark, sf)
    near = settled(knn.shells(train, FLAGS, wanted=test, enough=361))
    out = test.withColumn("code", knn.bit_code(FLAGS))
    for kernel in settings.KERNELS:
        share = knn.neighbour_share(near, F.lit(360), kernel).withColumnRenamed("p_event", kernel)
        out = out.join(share, "code").withColumn(kernel, r6(kernel))
    return out.drop("code")


@query("guideline_model", f"""
WITH {TT_SQL}, shares AS (SELECT guideline::INT AS score, avg(is_event::INT) AS risk FROM tt WHERE split = 'train' GROUP BY 1)
SELECT t.guideline::INT AS score, CASE WHEN t.guideline THEN 'Abnormal' ELSE 'Normal' END AS pred_class, is_event, round(risk, 6) AS p_event, count(*) AS n
FROM tt t JOIN shares s ON t.guideline::INT = s.score WHERE split = 'test' GROUP BY ALL""")
def guideline_model(spark, sf):
    s = train_test(spark, sf)
    shares = guideline.rule_shares(s.filter("split = 'train'"), F.col("guideline"))
    pred = guideline.rule_predictions(s.filter("split = 'test'"), F.col("guideline"), shares, ["is_event"])
    return pred.groupBy("score", "pred_class", "is_event", r6("p_event").alias("p_event")).agg(F.count("*").alias("n"))


@query("card_losses", f"""
WITH {STUDY_SQL}, l AS (
  SELECT unnest(['C0', 'C1', 'C2']) AS card, unnest([-3.0 + guideline::INT, -3.0 + 3 * hx_returned::INT - 2 * hx_bulk::INT + 5 * hx_many::INT,
    (-3.0 + hx_deep_discount::INT + 2 * hx_high_tax::INT - hx_many::INT) / 2.0]::DOUBLE[]) AS eta, is_event FROM study)
SELECT card, round(sum(CASE WHEN is_event THEN -ln(1 / (1 + exp(-eta))) ELSE -ln(1 - 1 / (1 + exp(-eta))) END), 4) AS loss FROM l GROUP BY card""")
def card_losses(spark, sf):
    """Log loss of several cards at once over the pattern table."""
    pats = patterns(study(spark, sf), [*FLAGS, "guideline"])
    fits = {
        name: linear.LinearFit(b0 / m, {k: v / m for k, v in pts.items()}) for name, (b0, m, pts) in CARDS.items()
    }
    found = batch_fit.losses(pats, fits)
    return spark.createDataFrame(list(found.items()), "card string, loss double").withColumn(
        "loss", F.round("loss", 4))


SMALL_MULTIPLIERS = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
SMALL_POOL = 6


@query("card_search", f"""
WITH {TT_SQL}, train AS (SELECT {', '.join(f + '::INT AS ' + f for f in FLAGS)}, count(*)::DOUBLE AS n, sum(is_event::INT)::DOUBLE AS pos FROM tt WHERE split = 'train' GROUP BY ALL),
v AS (SELECT unnest(range(-2, 3)) AS v), cards AS (SELECT {', '.join(f'p{k}.v AS c{k}' for k in range(len(FLAGS)))} FROM {', '.join(f'v p{k}' for k in range(len(FLAGS)))}),
sums AS (SELECT {', '.join(f'c{k}' for k in range(len(FLAGS)))}, {' + '.join(f'c{k} * {f}' for k, f in enumerate(FLAGS))} AS score, sum(n) AS n, sum(pos) AS pos FROM cards, train GROUP BY ALL),
shifts AS (SELECT unnest(range(-30, 11)) AS b0), stretch AS (SELECT unnest({SMALL_MULTIPLIERS}::DOUBLE[]) AS m),
loss AS (SELECT {', '.join(f'c{k}' for k in range(len(FLAGS)))}, b0, m, sum(n * (greatest((b0 + score) / m, 0) + ln(1 + exp(-abs((b0 + score) / m)))) - pos * (b0 + score) / m) AS loss
  FROM sums, shifts, stretch GROUP BY ALL),
per AS (SELECT {', '.join(f'c{k}' for k in range(len(FLAGS)))}, min(loss) AS loss FROM loss GROUP BY ALL),
best AS (SELECT *, row_number() OVER (ORDER BY loss) AS number, min(loss) OVER () AS least FROM per)
SELECT number, round(loss, 3) AS loss FROM best WHERE number <= {SMALL_POOL} AND loss <= 1.05::DOUBLE * least""")
def search(spark, sf):
    """The whole search on five items and up to two points each: its pool is that of all cards there are."""
    train, _ = pattern_sets(spark, sf)
    found = card_search.card_search(train, FLAGS, terms=len(FLAGS), bound=2, pool=SMALL_POOL, beam=12, multipliers=SMALL_MULTIPLIERS)
    return spark.createDataFrame([(c.number, c.loss) for c in found], "number long, loss double").withColumn("loss", F.round("loss", 3))


@query("card_search_pool")
def card_search_pool(spark, sf):
    """The whole search with the first round's settings, and the found cards' counts on the test rows."""
    train, test = pattern_sets(spark, sf)
    found = card_search.card_search(train, FLAGS, terms=7, bound=5, pool=6, beam=12, multipliers=24)
    cards = {f"#{c.number}": (c.intercept, c.multiplier, c.points) for c in found}
    scored = card_ops.score_records(test, cards, ["pos", "n"])
    facts = spark.createDataFrame(
        [(f"#{c.number}", c.number, c.intercept, c.multiplier, json.dumps(c.points, sort_keys=True), c.loss) for c in found],
        "card string, number int, intercept double, multiplier double, points string, train_loss double")
    counts = scored.groupBy("card", "score", "risk").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return counts.join(F.broadcast(facts), "card")


def conditional_table(spark, sf):
    c = cohort(spark, sf).filter(
        (F.col("smoking_history_cigarette") != "(Missing)") & (F.col("any_tobacco_exposure") != "(Missing)"))
    c = c.withColumn("age_guess", clean.age_guess())
    c = conditional.with_classes(c).dropna(subset=[*FLAGS, "age_guess", "smoking_history_cigarette"]).select(
        "record_id", "genotype", "abnormal", "is_zz", "age_guess", "smoking_history_cigarette",
        "any_tobacco_exposure", *FLAGS)
    return resample.split(settled(c), ["abnormal"], "record_id", 2 / 3)


@query("conditional_shares", f"""
WITH {COHORT_SQL}, c AS (SELECT record_id, genotype IN ('SZ', 'ZZ') AS abnormal, genotype FROM cohort
   WHERE genotype IS NOT NULL AND any_tobacco_exposure <> '(Missing)' AND hx_returned IS NOT NULL
     AND coalesce(age_calculated::VARCHAR, date_of_birth::VARCHAR) IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY abnormal ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS pos, count(*) OVER (PARTITION BY abnormal) AS n FROM c)
SELECT round(avg((genotype = 'ZZ')::INT), 6) AS p_zz, round(avg((genotype = 'SZ')::INT), 6) AS p_sz FROM p
WHERE abnormal AND pos <= floor(n * (2 / 3.0::DOUBLE))""")
def conditional_shares(spark, sf):
    shares = conditional.abnormal_shares(conditional_table(spark, sf).filter("split = 'train'"))
    return shares.select(r6("p_zz").alias("p_zz"), r6("p_sz").alias("p_sz"))


@query("conditional_fit", f"""
WITH {COHORT_SQL}, c AS (SELECT record_id, genotype IN ('SZ', 'ZZ') AS abnormal, genotype FROM cohort
   WHERE genotype IS NOT NULL AND smoking_history_cigarette <> '(Missing)' AND any_tobacco_exposure <> '(Missing)' AND hx_returned IS NOT NULL
     AND coalesce(age_calculated::VARCHAR, date_of_birth::VARCHAR) IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY abnormal ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS pos, count(*) OVER (PARTITION BY abnormal) AS n FROM c),
t AS (SELECT * FROM p WHERE pos <= floor(n * (2 / 3.0::DOUBLE))),
s AS (SELECT unnest({list(conditional.STAGE_TWO)}) AS predictors)
SELECT predictors, (SELECT sum(abnormal::INT)::DOUBLE FROM t) AS abnormal, (SELECT sum((genotype = 'ZZ')::INT)::DOUBLE FROM t WHERE abnormal) AS zz FROM s""")
def conditional_fit(spark, sf):
    """Both stages of every specification reproduce the events of the rows they were fitted on."""
    t = settled(conditional_table(spark, sf).filter("split = 'train'"))
    pred = settled(conditional.bound(conditional.fit_stages(t, FLAGS), t, ["abnormal"]))
    one = lambda name: F.struct(F.lit(name).alias("predictors"), F.col(f"p_zz_abnormal | {name}").alias("p"))
    rows = pred.select("abnormal", "p_abnormal", F.inline(F.array(*[one(name) for name in conditional.STAGE_TWO])))
    return rows.groupBy("predictors").agg(F.round(F.sum("p_abnormal"), 1).alias("abnormal"), F.round(F.sum(F.when(F.col("abnormal"), F.col("p"))), 1).alias("zz"))


COND_ITEMS = ["", *FLAGS, "age_guess"]
COND_SQL = f"""{COHORT_SQL}, {AGE_SQL}, ref AS (
  SELECT *, 2009 - year(date_of_birth) - CASE WHEN CAST(date_of_birth + to_months(CAST(12 * (2009 - year(date_of_birth)) AS INT)) AS DATE)
     > DATE '2009-01-01' THEN 1 ELSE 0 END AS k FROM aged),
guess AS (SELECT record_id, coalesce(age_calculated, age_years, k + (DATE '2009-01-01' - CAST(date_of_birth + to_months(CAST(12 * k AS INT)) AS DATE))
   / (CAST(date_of_birth + to_months(CAST(12 * (k + 1) AS INT)) AS DATE) - CAST(date_of_birth + to_months(CAST(12 * k AS INT)) AS DATE))::DOUBLE) AS age_guess FROM ref),
c AS (SELECT cohort.*, age_guess, genotype IN ('SZ', 'ZZ') AS abnormal FROM cohort JOIN guess USING (record_id)
   WHERE genotype IS NOT NULL AND smoking_history_cigarette <> '(Missing)' AND any_tobacco_exposure <> '(Missing)' AND hx_returned IS NOT NULL AND age_guess IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY abnormal ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS pos, count(*) OVER (PARTITION BY abnormal) AS n FROM c),
t AS (SELECT * FROM p WHERE pos <= floor(n * (2 / 3.0::DOUBLE)))"""


@query("conditional_equations", f"WITH {COND_SQL} " + " UNION ALL ".join(
    [f"SELECT 'abnormal' AS fit, '{f}' AS item, round(sum(abnormal::INT{' * ' + f + '::DOUBLE' if f else ''}), 1)::DOUBLE + 0.0 AS total FROM t" for f in ["", *FLAGS]]
    + [f"SELECT '{name}', '{f}', round(sum((genotype = 'ZZ')::INT{' * ' + f + '::DOUBLE' if f else ''}), 1)::DOUBLE + 0.0 FROM t WHERE abnormal"
       for name, extra in conditional.STAGE_TWO.items() for f in COND_ITEMS if f != "age_guess" or f in extra]))
def conditional_equations(spark, sf):
    """At the optimum of each fit, age included, the fitted events of every item add up to the observed ones."""
    t = settled(conditional_table(spark, sf).filter("split = 'train'"))
    pred = settled(conditional.bound(conditional.fit_stages(t, FLAGS), t, ["record_id", "abnormal", "age_guess"]))
    rows = pred.join(t.select("record_id", *FLAGS), "record_id")
    cell = lambda fit, item, p: F.struct(F.lit(fit).alias("fit"), F.lit(item).alias("item"), (p * F.col(item).cast("double") if item else p).alias("x"))
    cells = [cell("abnormal", f, F.col("p_abnormal")) for f in ["", *FLAGS]] + [
        cell(name, f, F.when(F.col("abnormal"), F.col(f"p_zz_abnormal | {name}")))
        for name, extra in conditional.STAGE_TWO.items() for f in COND_ITEMS if f != "age_guess" or f in extra]
    return rows.select(F.inline(F.array(*[F.struct(c["fit"].alias("fit"), c["item"].alias("item"), c["x"].cast("double").alias("x")) for c in cells]))).groupBy("fit", "item").agg(
        (F.round(F.sum("x"), 1) + 0.0).alias("total"))


@query("conditional_bound")
def conditional_bound(spark, sf):
    """Stage one, the baseline and four specifications side by side for a sample of the test records of every genotype."""
    t = settled(conditional_table(spark, sf))
    sampled = resample.sample_each(t.filter("split = 'test'"), ["genotype"], "record_id", 4)
    wide = conditional.bound(conditional.fit_stages(t.filter("split = 'train'"), FLAGS), sampled, ["record_id", "genotype", "abnormal"])
    return wide.select("record_id", "genotype", "abnormal", *[F.round(c, 8).alias(c) for c in wide.columns[3:]])


@query("conditional_pred")
def conditional_pred(spark, sf):
    t = settled(conditional_table(spark, sf))
    return conditional.two_stage(
        t.filter("split = 'train'"), t.filter("split = 'test' AND abnormal"), FLAGS, ["record_id", "genotype"])


@query("demo_wide", f"""
WITH {TT_SQL}, p AS (
  SELECT *, row_number() OVER (PARTITION BY is_event, gender ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS k FROM tt WHERE split = 'test')
SELECT record_id, CASE WHEN is_event THEN 'Abnormal' ELSE 'Normal' END AS geno_class, gender,
  round(1 / (1 + exp(3 - guideline::INT)), 8) AS "pred_C0",
  round(1 / (1 + exp(3 - (3 * hx_returned::INT - 2 * hx_bulk::INT + 5 * hx_many::INT))), 8) AS "pred_C1",
  round(1 / (1 + exp((3 - (hx_deep_discount::INT + 2 * hx_high_tax::INT - hx_many::INT)) / 2.0::DOUBLE)), 8) AS "pred_C2"
FROM p WHERE k <= 4""")
def demo_wide(spark, sf):
    """All cards' risks side by side for a few test records of every cell."""
    test = train_test(spark, sf).filter("split = 'test'")
    sampled = resample.sample_each(test, ["is_event", "gender"], "record_id", 4)
    risks = {
        f"pred_{name}": F.round(card_ops.risk_of(card_ops.card_score(pts), F.lit(b0), F.lit(m)), 8)
        for name, (b0, m, pts) in CARDS.items()
    }
    return sampled.withColumns(risks).select(
        "record_id", class_label(F.col("is_event")).alias("geno_class"), "gender", *risks)


