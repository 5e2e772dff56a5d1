"""Runners of the second and third round over all cells, with stored flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard import settings
from tallycard.functions.select import chosen
from tallycard.plans import final, tuning
from tallycard.plans.preprocess import StudyTables
from tallycard.plans.selection import CELL, cell_table
from tallycard.plans.tuning import METRICS_SCHEMA, resume, resume_many

#: Stored tables of the third round.
FINAL_SCHEMAS = {
    name: f"{ddl}, {CELL}" for name, ddl in {
        "models": "card string, family string, penalty double, terms int, bound int, number int, intercept double, "
                  "multiplier double, referent_risk double",
        "points": "card string, item string, points int",
        "risks": "card string, score bigint, score_adj double, risk double",
        "roc": "card string, score bigint, sensitivity double, specificity double",
        "predictions": "record_id bigint, is_event boolean, card string, score bigint, risk double, pred_class string",
        "cutoffs": "card string, score_cutoff bigint, risk_cutoff double, specificity double, sensitivity double",
        "metrics": "card string, metric string, estimator string, estimate double",
    }.items()
}


def union_width(tables: StudyTables, specs=settings.PREDICTORS) -> int:
    """Number of predictor columns in the union of all specifications."""
    every = {c for spec in specs.values() for c in chosen(tables.predictors.columns, spec, drop=settings.NOT_PREDICTORS)}
    return len(every)


def run_second(spark: SparkSession, tables: StudyTables, path: str, specs=settings.PREDICTORS,
               tests: dict[str, Column] | None = None, **options) -> DataFrame:
    """Cross-validated metrics of every cell on the training records, stored one by one.

    All cells share the grids that follow from the union of the specifications.
    """
    tests = tests or settings.responses()
    ids = tables.split.filter("split = 'train'").select("record_id")
    width = union_width(tables, specs)

    def one(cell: dict[str, str]) -> DataFrame:
        rows, columns = cell_table(tables, ids, specs[cell["predictors"]], tests[cell["response"]])
        found = tuning.run_cell(rows, columns, n_predictors=width, **options)
        return found.select(*[c for c in METRICS_SCHEMA.names if c in found.columns])

    cells = [{"predictors": p, "response": r} for p in specs for r in tests]
    return resume(spark, path, cells, METRICS_SCHEMA, one)


def run_third(spark: SparkSession, tables: StudyTables, path: str, rule: Column, rule_columns: tuple[str, ...],
              specs=settings.PREDICTORS, tests: dict[str, Column] | None = None, **options) -> dict[str, DataFrame]:
    """Cards of every cell, fitted on the training records and judged on the held-out ones; seven stored tables.

    ``rule`` is the existing guideline over ``rule_columns``.
    """
    tests = tests or settings.responses()
    ids = tables.split.select("record_id")

    def one(cell: dict[str, str]) -> dict[str, DataFrame]:
        rows, columns = cell_table(tables, ids, specs[cell["predictors"]], tests[cell["response"]], rule_columns)
        both = rows.join(tables.split.select("record_id", "split"), "record_id")
        side = lambda s: both.filter(F.col("split") == s).drop("split")
        found = final.evaluate(spark, side("train"), side("test"), columns, rule, **options)
        typed = lambda schema: [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(schema).fields if f.name not in cell]
        return {name: getattr(found, name).select(*typed(schema)) for name, schema in FINAL_SCHEMAS.items()}

    cells = [{"predictors": p, "response": r} for p in specs for r in tests]
    return resume_many(spark, path, cells, FINAL_SCHEMAS, one)
