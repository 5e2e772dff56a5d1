"""Raw record table to stored predictor, response, inclusion and split tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.select import union_of_specs
from tallycard.functions.values import keep_levels
from tallycard.operators import clean, resample
from tallycard.sources.tables import write_table


@dataclass(frozen=True)
class StudyTables:
    predictors: DataFrame
    responses: DataFrame
    included: DataFrame
    split: DataFrame


def typed(raw: DataFrame) -> DataFrame:
    """Names, dates, yes/no columns and categories of a table read as text."""
    df = clean.typed_dates(clean.history_names(raw))
    df = clean.typed_booleans(df, clean.boolean_columns(df))
    if "smoking_history_cigarette" in df.columns:
        df = df.withColumn(
            "smoking_history_cigarette", keep_levels(F.col("smoking_history_cigarette"), settings.SMOKING_LEVELS))
    if "physician_specialty" in df.columns:
        df = df.withColumn("physician_specialty", clean.recode_category(F.col("physician_specialty")))
    return df


def complete_split(predictors: DataFrame, responses: DataFrame, train: float = settings.TRAIN_FRACTION,
                   seed=settings.SEED) -> DataFrame:
    """Train/test by genotype group over records complete in every specification."""
    wanted = union_of_specs(predictors.columns, settings.PREDICTORS)
    complete = predictors.select("record_id", *wanted)
    if "gender" in wanted:
        complete = complete.filter(F.col("gender") != "(Missing)")
    ids = complete.dropna().select("record_id").join(responses.select("record_id", "genotype"), "record_id")
    strata = ids.select("record_id", resample.genotype_stratum().alias("stratum"))
    return resample.split(strata, ["stratum"], "record_id", train, seed)


def prepare(spark: SparkSession, raw: DataFrame, path: str) -> StudyTables:
    """Build the four tables, each written once and read back for what follows."""
    write_table(typed(raw), f"{path}/typed")
    table = spark.read.parquet(f"{path}/typed")
    predictors = clean.predictor_table(table)
    write_table(predictors, f"{path}/predictors")
    predictors = spark.read.parquet(f"{path}/predictors")
    write_table(clean.response_table(table, predictors), f"{path}/responses")
    responses = spark.read.parquet(f"{path}/responses")
    write_table(clean.frequent_levels(responses, "genotype").select("genotype"), f"{path}/included")
    write_table(complete_split(predictors, responses), f"{path}/split")
    return open_tables(spark, path)


def open_tables(spark: SparkSession, path: str) -> StudyTables:
    return StudyTables(*[spark.read.parquet(f"{path}/{n}") for n in ("predictors", "responses", "included", "split")])
