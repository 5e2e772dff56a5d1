"""Grids of settings x folds, fitted cell by cell and resumable."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard import settings
from tallycard.models.batch_fit import FitSpec, fit_many
from tallycard.models.card_search import search_cards
from tallycard.models.forests import Family, forest_shares, grow_forests
from tallycard.models.knn import bit_code, neighbour_share, shells, without_fold
from tallycard.operators import resample
from tallycard.operators.cards import score_records
from tallycard.operators.encode import Encoder, patterns
from tallycard.operators.evaluate import metric_table
from tallycard.session import settled
from tallycard.sources.cells import manifest, publish, published
from tallycard.sources.tables import pending_cells


def _setting(model: str, **values) -> Column:
    kinds = {"log_penalty": "int", "trees": "int", "mtry": "int", "neighbors": "int", "weight_func": "string",
             "terms": "int", "bound": "int"}
    return F.struct(F.lit(model).alias("model"), *[F.lit(values.get(k)).cast(t).alias(k) for k, t in kinds.items()])


def tuning_grid(folds: DataFrame, n_predictors: int) -> DataFrame:
    """Every setting of every family for every row of ``folds``.

    ``n_predictors`` is the width of the union of all specifications; it sets
    the numbers of predictors per split and the larger number of card terms.
    """
    rows = [_setting("logistic regression", log_penalty=p) for p in (-10, -8, -6, -4, -2, 0)]
    rows += [_setting("random forest", trees=t, mtry=m)
             for t in settings.TREES for m in settings.mtry_grid(n_predictors)]
    rows += [_setting("nearest neighbors", neighbors=k, weight_func=w)
             for w in settings.KERNELS for k in settings.NEIGHBORS]
    rows += [_setting("integer card", terms=t, bound=b)
             for t in (settings.CARD_TERMS_LOW, n_predictors - 1) for b in settings.CARD_BOUNDS]
    return folds.select(F.inline(F.array(*rows)), "*")


def ridge_cv(pats: DataFrame, features: list[str], penalties: list[float], v: int) -> DataFrame:
    """Metrics of every penalty on every fold, from patterns per fold.

    All fits share their Newton steps; the held-out patterns of a fold are
    scored by an expression per penalty.
    """
    pats = settled(pats)
    specs = [FitSpec(f"{p!r}|{k}", tuple(features), p, k) for p in penalties for k in range(1, v + 1)]
    fits = fit_many(pats, specs)

    def held_out(p: float) -> Column:
        out = F.lit(None).cast("double")
        for k in range(1, v + 1):
            out = F.when(F.col("fold") == k, fits[f"{p!r}|{k}"].p_event()).otherwise(out)
        return out

    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("penalty"), held_out(p).alias("p_event")) for p in penalties]))
    counted = pats.select("fold", "pos", "n", rows).withColumn(
        "pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))
    return metric_table(counted, ["penalty", "fold"], discrete=True, counted=True)


def knn_cv(pats: DataFrame, features: list[str], neighbors: list[int], kernels: list[str], v: int) -> DataFrame:
    """Metrics of every number of neighbours and kernel on every fold, one pass of shells."""
    pats = settled(pats)
    near = settled(without_fold(shells(pats, features, keys=["fold"], enough=max(neighbors) + 1), v))
    coded = pats.withColumn("code", bit_code(features))
    parts = []
    for kernel in kernels:
        many = near.withColumn("neighbors", F.explode(F.lit(neighbors)))
        share = neighbour_share(many, F.col("neighbors"), kernel, ["fold", "neighbors"])
        parts.append(coded.join(share, ["fold", "code"]).withColumn("weight_func", F.lit(kernel)))
    pred = reduce(DataFrame.unionByName, parts).withColumn(
        "pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))
    return metric_table(pred, ["neighbors", "weight_func", "fold"], discrete=True, counted=True)


def forest_cv(rows: DataFrame, features: list[str], trees: list[int], mtry: list[int], v: int, least: int = 1) -> DataFrame:
    """Metrics of forests per number of trees, predictors per split and fold, all grown together.

    ``rows`` are single records (record_id, fold, is_event, features).
    """
    rows = settled(rows)
    families = [Family(k * len(mtry) + i, m, k) for k in range(1, v + 1) for i, m in enumerate(mtry)]
    grown = grow_forests(rows, features, families, max(trees), least=least)
    shares = forest_shares(grown.leaves, trees)
    facts = rows.sparkSession.createDataFrame([(f.number, f.mtry, f.leave_out) for f in families], "family int, mtry int, fold int")
    held = rows.groupBy("fold", bit_code(features).alias("code")).agg(F.count("*").alias("n"), F.sum(F.col("is_event").cast("long")).alias("pos"))
    pred = shares.join(F.broadcast(facts), "family").join(held, ["fold", "code"]).withColumn(
        "pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))
    return metric_table(pred, ["trees", "mtry", "fold"], discrete=True, counted=True)


def card_cv(pats: DataFrame, features: list[str], terms: list[int], bounds: list[int], v: int, pool: int = 2,
            beam: int = 8, multipliers: int = 16) -> DataFrame:
    """Metrics of searched cards per setting, fold and number in the pool."""
    pats = settled(pats)
    parts = []
    for k in range(1, v + 1):
        train = pats.filter(F.col("fold") != k).groupBy(*features).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        test = pats.filter(F.col("fold") == k)
        for (t, b), found in search_cards(train, features, terms, bounds, pool, beam, multipliers).items():
            cards = {str(c.number): (c.intercept, c.multiplier, c.points) for c in found}
            scored = score_records(test, cards, ["fold", "pos", "n"])
            parts.append(scored.select(
                F.lit(t).alias("terms"), F.lit(b).alias("bound"), F.col("card").cast("int").alias("number"),
                "fold", "pos", "n", F.col("risk").alias("p_event")))
    pred = reduce(DataFrame.unionByName, parts).withColumn(
        "pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))
    return metric_table(pred, ["terms", "bound", "number", "fold"], discrete=True, counted=True)


METRICS_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in [
        ("model", T.StringType()), ("penalty", T.DoubleType()), ("trees", T.IntegerType()), ("mtry", T.IntegerType()),
        ("neighbors", T.IntegerType()), ("weight_func", T.StringType()), ("terms", T.IntegerType()),
        ("bound", T.IntegerType()), ("number", T.IntegerType()), ("fold", T.IntegerType()), ("metric", T.StringType()),
        ("estimator", T.StringType()), ("estimate", T.DoubleType()), ("predictors", T.StringType()),
        ("response", T.StringType())]
])


def run_cell(train: DataFrame, columns: list[str], v: int = settings.N_FOLDS, penalties=settings.PENALTIES,
             neighbors=settings.NEIGHBORS, kernels=settings.KERNELS, trees=settings.TREES, mtry=None, terms=None,
             bounds=settings.CARD_BOUNDS, pool: int = 2, beam: int = 8, multipliers: int = 16,
             seed=settings.SEED, n_predictors: int | None = None) -> DataFrame:
    """Second round, one cell: all families on the same folds, metrics stacked.

    ``n_predictors`` is the width of the union of all specifications, from which
    the grids follow; by default this cell's own.

    ``train``: record_id, is_event and the predictor columns of the training
    records. Settings a family does not have are NULL.
    """
    plain = settled(train.select("record_id", "is_event", *columns))
    folded = settled(resample.folds(plain, ["is_event"], "record_id", v, seed))
    carry = ["record_id", "is_event", "fold"]
    # linear models and cards leave out a reference level, neighbours and forests see all levels
    reg = Encoder(columns, carry, drop_constant=False).fit(folded)
    num = Encoder(columns, carry, full=True, drop_constant=False).fit(folded)
    pats = settled(patterns(reg.transform(folded), reg.features, keys=["fold"]))
    num_pats = settled(patterns(num.transform(folded), num.features, keys=["fold"]))
    n = n_predictors or len(columns)
    mtry = settings.mtry_grid(n) if mtry is None else mtry
    terms = [settings.CARD_TERMS_LOW, max(n - 1, 1)] if terms is None else terms
    rows = num.transform(folded).withColumn("label", F.col("is_event").cast("double"))
    parts = {
        "logistic regression": ridge_cv(pats, reg.features, penalties, v),
        "nearest neighbors": knn_cv(num_pats, num.features, neighbors, kernels, v),
        "random forest": forest_cv(rows, num.features, trees, mtry, v),
        "integer card": card_cv(pats, reg.features, terms, bounds, v, pool, beam, multipliers),
    }
    named = [df.withColumn("model", F.lit(m)) for m, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def resume_many(spark: SparkSession, path: str, cells: list[dict[str, str]], schemas: dict[str, T.StructType | str],
                run_cell: Callable[[dict[str, str]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Run the cells that are not published yet and return the whole tables, one folder of ``path`` each.

    A cell's tables are published together, so a broken run continues with the cell it broke in, and no reader sees a
    part of one.
    """
    names = list(cells[0])
    grid = spark.createDataFrame([tuple(c[n] for n in names) for c in cells], ", ".join(f"{n} string" for n in names))
    for row in pending_cells(grid, manifest(spark, path, names), names).collect():  # one row per experiment
        cell = row.asDict()
        found = run_cell(cell)
        publish({table: found[table] for table in schemas}, path, cell)
    return {table: published(spark, path, table, schema, names) for table, schema in schemas.items()}


def resume(spark: SparkSession, path: str, cells: list[dict[str, str]], schema: T.StructType,
           run_cell: Callable[[dict[str, str]], DataFrame], name: str = "results") -> DataFrame:
    """``resume_many`` for cells with one table."""
    return resume_many(spark, path, cells, {name: schema}, lambda cell: {name: run_cell(cell)})[name]
