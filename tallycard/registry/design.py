"""Resampling, experiment grids and feature coding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.select import chosen
from tallycard.functions.values import sign_change
from tallycard.operators import clean, resample
from tallycard.operators.encode import Encoder, constant_columns, patterns
from tallycard.plans.tuning import tuning_grid as grid_of
from tallycard.registry.base import query
from tallycard.registry.summaries import FOLD_SQL
from tallycard.registry.tables import SPECS, SPLIT_SQL, split_table
from tallycard.session import settled
from tallycard.sources.fixtures import COHORT_SQL, FLAGS, STUDY_SQL, cohort, order_side, study


@query("strat_split", f"WITH {COHORT_SQL}, {SPLIT_SQL} SELECT record_id, stratum, split FROM split")
def strat_split(spark, sf):
    return split_table(spark, sf).select("record_id", "stratum", "split")


@query("strat_split_nested", f"""
WITH {COHORT_SQL}, {SPLIT_SQL}, inner_placed AS (
  SELECT record_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('{settings.SEED}/inner|' || record_id), record_id) AS pos,
         count(*) OVER (PARTITION BY stratum) AS n FROM split WHERE split = 'train')
SELECT record_id, CASE WHEN pos <= floor(n * (2 / 3.0::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM inner_placed""")
def strat_split_nested(spark, sf):
    outer = split_table(spark, sf).filter("split = 'train'").select("record_id", "stratum")
    inner = resample.split(outer, ["stratum"], "record_id", settings.SUBSET_TRAIN, f"{settings.SEED}/inner")
    return inner.select("record_id", "split")


def folded(spark, sf):
    s = settled(study(spark, sf).select("record_id", "is_event", *FLAGS))
    return resample.folds(s, ["is_event"], "record_id")


@query("strat_folds", f"WITH {STUDY_SQL}, {FOLD_SQL} SELECT record_id, is_event, fold FROM folded")
def strat_folds(spark, sf):
    return folded(spark, sf).select("record_id", "is_event", "fold")


@query("fold_sizes", f"""
WITH {STUDY_SQL}, {FOLD_SQL}, k AS (SELECT DISTINCT fold AS k FROM folded)
SELECT k AS fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(is_event::INT)::BIGINT AS events
FROM folded, k GROUP BY ALL""")
def fold_sizes(spark, sf):
    return resample.fold_roles(folded(spark, sf))


@query("tuning_grid", f"""
WITH {STUDY_SQL}, {FOLD_SQL}, sizes AS (
  SELECT fold, (SELECT count(*) FROM folded) - count(*) AS n_train, count(*) AS n_test FROM folded GROUP BY fold),
np AS (SELECT 8 AS p),
grid AS (
  SELECT 'logistic regression' AS model, unnest([-10, -8, -6, -4, -2, 0])::INT AS log_penalty, NULL::INT AS trees, NULL::INT AS mtry,
         NULL::INT AS neighbors, NULL AS weight_func, NULL::INT AS terms, NULL::INT AS bound
  UNION ALL SELECT 'random forest', NULL, t, m, NULL, NULL, NULL, NULL FROM (SELECT unnest([1, 3, 10, 32, 100])::INT AS t),
         (SELECT DISTINCT unnest([round(pow(p, 1 / 3.0::DOUBLE))::INT, round(sqrt(p))::INT, p // 2])::INT AS m FROM np)
  UNION ALL SELECT 'nearest neighbors', NULL, NULL, NULL, k, w, NULL, NULL FROM (SELECT unnest([10, 100, 1000])::INT AS k),
         (SELECT unnest(['rectangular', 'triangular']) AS w)
  UNION ALL SELECT 'integer card', NULL, NULL, NULL, NULL, NULL, t, b FROM (SELECT unnest([5, p - 1])::INT AS t FROM np), (SELECT unnest([6, 21, 36])::INT AS b))
SELECT grid.*, sizes.* FROM grid, sizes""")
def tuning_grid(spark, sf):
    """Every setting of every family on every fold, with the sizes of the fold's sets."""
    names = cohort(spark, sf).columns
    n_pred = len(chosen(names, [s for spec in SPECS.values() for s in spec]))
    roles = resample.fold_roles(folded(spark, sf))
    sizes = roles.groupBy("fold").pivot("role", ["train", "test"]).agg(F.sum("n")).withColumnsRenamed(
        {"train": "n_train", "test": "n_test"})
    return grid_of(sizes, n_pred)


_responses = {"ZZ": "genotype = 'ZZ'", "SZ": "genotype IN ('SZ', 'ZZ')", "Ab": "genotype <> 'MM'"}
_spec_columns = {"Dx": [], "Dx+smoking": ["smoking_history_cigarette"], "Dx+gender": ["gender"], "Dx+exposure": ["any_tobacco_exposure"]}


@query("experiment_cells", f"WITH {COHORT_SQL} " + " UNION ALL ".join(
    f"SELECT '{s}' AS predictors, '{r}' AS response, count(*) AS n, sum(({t})::INT)::BIGINT AS events FROM cohort WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ["genotype", *FLAGS, *cols])
    for s, cols in _spec_columns.items() for r, t in _responses.items()))
def experiment_cells(spark, sf):
    """Complete cases and events of every (predictors, response) cell in one pass."""
    df = cohort(spark, sf)
    sums, structs = [], []
    for s, spec in SPECS.items():
        known = F.lit(True)
        for c in chosen(df.columns, spec):
            known = known & F.col(c).isNotNull()
        for r, test in settings.responses().items():
            i = len(structs)
            usable = known & test.isNotNull()
            sums += [F.count(F.when(usable, 1)).alias(f"n{i}"),
                     F.sum(F.when(usable, test.cast("long"))).alias(f"e{i}")]
            structs.append(F.struct(
                F.lit(s).alias("predictors"), F.lit(r).alias("response"), F.col(f"n{i}").alias("n"),
                F.col(f"e{i}").alias("events")))
    return df.agg(*sums).select(F.inline(F.array(*structs)))


@query("split_audit", f"""
WITH {COHORT_SQL}, {SPLIT_SQL}
SELECT count(*) AS ids, sum((split = 'train')::INT)::BIGINT AS train_ids, sum((split = 'test')::INT)::BIGINT AS test_ids,
  (SELECT count(*) FROM (SELECT record_id FROM split WHERE split = 'train' INTERSECT SELECT record_id FROM split WHERE split = 'test'))::BIGINT AS in_both,
  (SELECT count(*) FROM (SELECT record_id FROM split GROUP BY record_id, split HAVING count(*) > 1))::BIGINT AS listed_twice FROM split""")
def split_audit(spark, sf):
    return resample.split_audit(split_table(spark, sf), "record_id")


@query("zero_variance", f"""
WITH {STUDY_SQL}, t AS (SELECT *, 1 AS constant FROM study WHERE guideline)
SELECT unnest(['hx_returned', 'hx_bulk', 'hx_many', 'guideline', 'constant', 'n_lines']) AS column_name,
  unnest([count(DISTINCT hx_returned) <= 1, count(DISTINCT hx_bulk) <= 1, count(DISTINCT hx_many) <= 1, count(DISTINCT guideline) <= 1,
          count(DISTINCT constant) <= 1, count(DISTINCT n_lines) <= 1]) AS is_constant, unnest([count(*), count(*), count(*), count(*), count(*), count(*)]) AS n
FROM t""")
def zero_variance(spark, sf):
    train = study(spark, sf).filter("guideline").withColumn("constant", F.lit(1))
    columns = ["hx_returned", "hx_bulk", "hx_many", "guideline", "constant", "n_lines"]
    constant = constant_columns(train, columns)
    return train.agg(F.count("*").alias("n")).select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(c in constant).alias("is_constant")) for c in columns
        ])), "n")


@query("dummy_code", f"""
WITH {COHORT_SQL}, s AS (SELECT gender, CASE WHEN smoking_history_cigarette IN ('Past', 'Current') THEN smoking_history_cigarette ELSE 'Never' END AS u FROM cohort
  WHERE gender <> '(Missing)')
SELECT (gender = 'Male')::INT AS "gender_Male", (u = 'Past')::INT AS "smoking_use_Past", (u = 'Current')::INT AS "smoking_use_Current", count(*) AS n
FROM s GROUP BY ALL""")
def dummy_code(spark, sf):
    c = clean.with_smoking_classes(order_side(spark, sf).filter("gender <> '(Missing)'"))
    enc = Encoder(["gender", "smoking_use"], level_order={"smoking_use": settings.SMOKING_USE_LEVELS}).fit(c)
    return enc.transform(c).groupBy(*enc.features).agg(F.count("*").alias("n"))


@query("one_hot", f"""
WITH {COHORT_SQL}
SELECT (gender = '(Missing)')::INT AS "gender_(Missing)", (gender = 'Female')::INT AS "gender_Female", (gender = 'Male')::INT AS "gender_Male", count(*) AS n
FROM cohort GROUP BY ALL""")
def one_hot(spark, sf):
    c = order_side(spark, sf)
    enc = Encoder(["gender"], full=True).fit(c)
    return enc.transform(c).groupBy(*enc.features).agg(F.count("*").alias("n"))


@query("encode_binary", f"""
WITH {STUDY_SQL}
SELECT hx_bulk::INT AS hx_bulk, hx_many::INT AS hx_many, CASE WHEN is_event THEN 1 ELSE -1 END AS y, count(*) AS n FROM study GROUP BY ALL""")
def encode_binary(spark, sf):
    s = study(spark, sf)
    coded = Encoder(["hx_bulk", "hx_many"], carry=["is_event"]).fit(s).transform(s)
    return coded.groupBy("hx_bulk", "hx_many", sign_change(F.col("is_event")).alias("y")).agg(F.count("*").alias("n"))


@query("patterns", f"""
WITH {STUDY_SQL}
SELECT hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many, sum(is_event::INT)::BIGINT AS pos, count(*) AS n FROM study GROUP BY ALL""")
def pattern_table(spark, sf):
    return patterns(study(spark, sf), FLAGS)


