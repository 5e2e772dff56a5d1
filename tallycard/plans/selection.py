"""First round: nine model families and searched cards on one split of a subset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.select import Selector, chosen
from tallycard.models import card_search, knn, lda, linear, svm, trees
from tallycard.operators import clean, resample
from tallycard.operators.cards import score_records
from tallycard.operators.encode import Encoder, patterns, weighted_rows
from tallycard.operators.evaluate import confusion_counts, metric_table, screen_performance
from tallycard.plans.preprocess import StudyTables
from tallycard.plans.tuning import resume_many
from tallycard.session import settled

CARRY = ["record_id", "is_event"]


def subset_ids(tables: StudyTables, share: float = settings.SUBSET_FRACTION) -> DataFrame:
    """Fixed stratified sample of the training ids; ``share`` is of all records."""
    train = tables.split.filter("split = 'train'")
    return resample.stratified_sample(train, ["stratum"], "record_id", share / settings.TRAIN_FRACTION).select("record_id")


def cell_table(tables: StudyTables, ids: DataFrame, spec: list[Selector], test: Column,
               extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Labelled complete cases of one (predictors, response) cell, and its predictor columns."""
    columns = chosen(tables.predictors.columns, spec, drop=settings.NOT_PREDICTORS)
    more = [c for c in extra if c not in columns]
    chosen_rows = tables.predictors.select("record_id", *columns, *more).join(ids, "record_id", "left_semi")
    return settled(clean.analysis_table(chosen_rows, tables.responses, [*columns, *more], tables.included, test)), columns


def guideline_rule(df: DataFrame) -> Column:
    """The first round's rule: obstructive disease in any of three forms."""
    return F.col("lung_hx_copd") | F.col("lung_hx_emphysema") | F.col("lung_hx_chronic_bronchitis")


def fit_families(train: DataFrame, test: DataFrame, columns: list[str], forest_trees: int = 120,
                 neighbors: int = 360) -> DataFrame:
    """Predictions of all nine families for the test records, stacked."""
    reg = Encoder(columns, CARRY).fit(train)
    num = Encoder(columns, CARRY, full=True, drop_constant=False).fit(train)
    reg_train, reg_test = settled(reg.transform(train)), settled(reg.transform(test))
    num_train, num_test = settled(num.transform(train)), settled(num.transform(test))
    pats = settled(patterns(reg_train, reg.features))
    num_pats = settled(patterns(num_train, num.features))
    rows, num_rows = weighted_rows(pats, reg.features), weighted_rows(num_pats, num.features)

    lr = linear.fit_logistic(rows, reg.features)
    disc = lda.fit_lda(lda.lda_moments(reg_train, reg.features), reg.features)
    small_tree = trees.fit_tree(num_rows, num.features, depth=None)
    rules = trees.rule_conditions(small_tree, num.features)
    rule_p = {r["rule_id"]: float(r["p_event"]) for r in trees.rule_table(num_pats, rules).collect()}
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in rule_p.items() for x in kv]), trees.rule_number(rules))
    tree = trees.fit_tree(num_rows, num.features, depth=7)
    forest = trees.fit_forest(
        num_train.withColumn("label", F.col("is_event").cast("double")), num.features, forest_trees, 4)
    near = knn.knn_predict(num_pats, num_test, num.features, neighbors, "triangular")
    out = {
        "logistic regression": linear.classed(reg_test, CARRY, lr.p_event()),
        "linear discriminant": linear.classed(reg_test, CARRY, disc.p_event()),
        "decision rules": linear.classed(num_test, CARRY, by_rule),
        "decision tree": trees.predicted(tree, num_test, num.features, CARRY),
        "random forest": trees.predicted(forest, num_test, num.features, CARRY),
        "nearest neighbor": linear.classed(near, CARRY, F.col("p_event")),
        "linear svm": svm.fit_svm_linear(num_rows, num.features).predict(num_test, CARRY),
        "quadratic svm": svm.fit_svm_poly(num_rows, num.features, 2).predict(num_test, CARRY),
        "cubic svm": svm.fit_svm_poly(num_rows, num.features, 3).predict(num_test, CARRY),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("model", F.lit(name)) for name, df in out.items()])


def fit_cards(train: DataFrame, test: DataFrame, columns: list[str], terms: int = 7, bound: int = 5, pool: int = 6,
              beam: int = 12, multipliers: int = 24) -> DataFrame:
    """Predictions of the searched cards for the test records, numbered by rank."""
    enc = Encoder(columns, CARRY, drop_constant=False).fit(train)
    pats = patterns(enc.transform(train), enc.features)
    found = card_search.card_search(pats, enc.features, terms, bound, pool, beam, multipliers)
    cards = {f"integer card {c.number}": (c.intercept, c.multiplier, c.points) for c in found}
    scored = score_records(enc.transform(test), cards, CARRY)
    return scored.select(
        *CARRY, F.col("risk").alias("p_event"),
        F.when(F.col("risk") >= 0.5, "Abnormal").otherwise("Normal").alias("pred_class"), F.col("card").alias("model"))


def run_cell(tables: StudyTables, ids: DataFrame, spec: list[Selector], test: Column, seed=settings.SEED,
             with_cards: bool = True, **fit_options) -> dict[str, DataFrame]:
    """One cell of the first round: guideline rates, predictions, counts, metrics."""
    rule_columns = ("lung_hx_copd", "lung_hx_emphysema", "lung_hx_chronic_bronchitis")
    cell, columns = cell_table(tables, ids, spec, test, rule_columns)
    parted = settled(resample.split(cell, ["is_event"], "record_id", settings.SUBSET_TRAIN, seed))
    train, held = parted.filter("split = 'train'"), parted.filter("split = 'test'")
    pred = fit_families(train, held, columns, **fit_options)
    if with_cards:
        pred = pred.unionByName(fit_cards(train, held, columns))
    pred = settled(pred)
    truth = F.when(F.col("is_event"), "Abnormal").otherwise("Normal")
    return {
        "guideline": screen_performance(cell, guideline_rule(cell), F.col("is_event")),
        "predictions": pred,
        "counts": confusion_counts(pred.withColumn("truth", truth), ["model"]),
        "metrics": metric_table(pred, ["model"]),
    }


CELL = "predictors string, response string"
#: The stored tables of the round.
ROUND_SCHEMAS = {
    name: f"{ddl}, {CELL}" for name, ddl in {
        "guideline": "tp bigint, tn bigint, fp bigint, fn bigint, sensitivity double, specificity double, precision double, recall double",
        "counts": "model string, pred_class string, truth string, n bigint",
        "metrics": "model string, metric string, estimator string, estimate double",
        "predictions": "record_id bigint, is_event boolean, p_event double, pred_class string, model string",
    }.items()
}


def run_round(spark: SparkSession, tables: StudyTables, path: str, specs=settings.PREDICTORS,
              tests: dict[str, Column] | None = None, share: float = settings.SUBSET_FRACTION, **options) -> dict[str, DataFrame]:
    """All (predictors, response) cells, stored one by one; a broken run continues where it stopped.

    Four tables below ``path``: guideline rates, predictions, counts, and metrics.
    """
    tests = tests or settings.responses()
    ids = settled(subset_ids(tables, share))
    cells = [{"predictors": p, "response": r} for p in specs for r in tests]

    def one(cell: dict[str, str]) -> dict[str, DataFrame]:
        out = run_cell(tables, ids, specs[cell["predictors"]], tests[cell["response"]], **options)
        return out

    return resume_many(spark, path, cells, ROUND_SCHEMAS, one)
