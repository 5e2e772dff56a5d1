"""Cohort-shaped views over the driver tables (see FIXTURES.md section 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard import settings

FLAGS = ["hx_returned", "hx_deep_discount", "hx_bulk", "hx_high_tax", "hx_many"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record-level columns that need no line items."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    priority = F.substring("o_orderpriority", 1, 1)
    smoking = F.when(priority == "5", settings.SMOKING_LEVELS[0])
    for mark, level in zip("4321", settings.SMOKING_LEVELS[1:]):
        smoking = smoking.when(priority == mark, level)
    return table(spark, sf_dir, "orders").select(
        key.alias("record_id"),
        F.when(key % 97 == 0, None)
        .when(price >= 480000, "ZZ").when(price >= 450000, "SZ").when(price >= 300000, "MZ")
        .otherwise("MM").alias("genotype"),
        F.when(F.col("o_orderstatus") == "F", "Female").when(F.col("o_orderstatus") == "O", "Male")
        .otherwise("(Missing)").alias("gender"),
        smoking.alias("smoking_history_cigarette"),
        F.when(key % 5 == 0, "(Missing)").when(priority.isin("1", "2", "3"), "Yes")
        .otherwise("No").alias("any_tobacco_exposure"),
        F.when(key % 11 != 0, F.col("o_orderdate").cast("date")).alias("date_of_birth"),
        F.when(key % 3 == 0, F.round(price / 10000, 2)).alias("age_calculated"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; flags are NULL for orders without line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("hx_returned"),
        F.bool_or(F.col("l_discount") >= 0.08).alias("hx_deep_discount"),
        F.bool_or(F.col("l_quantity") >= 45).alias("hx_bulk"),
        F.bool_or(F.col("l_tax") >= 0.07).alias("hx_high_tax"),
        (F.count("*") >= 6).alias("hx_many"),
        F.count("*").alias("n_lines"),
        F.max("l_quantity").alias("max_quantity"),
        F.min("l_shipdate").cast("date").alias("first_ship"),
    )
    joined = order_side(spark, sf_dir).join(lines, "record_id", "left")
    received = F.when(F.col("record_id") % 7 != 0, F.col("first_ship"))
    return joined.withColumn("date_received", received).drop("first_ship")


def guideline_v1() -> Column:
    return F.col("hx_bulk") | F.col("hx_many")


def guideline_v2() -> Column:
    return guideline_v1() | F.col("hx_high_tax")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases with a known response: what the fits and screens run on."""
    return (
        cohort(spark, sf_dir)
        .withColumn("is_event", settings.responses()["ZZ"])
        .dropna(subset=["is_event", *FLAGS])
        .withColumn("guideline", guideline_v1())
    )


# card -> (intercept, multiplier, item points)
CARDS = {
    "C0": (-3.0, 1.0, {"guideline": 1}),
    "C1": (-3.0, 1.0, {"hx_returned": 3, "hx_bulk": -2, "hx_many": 5}),
    "C2": (-3.0, 2.0, {"hx_deep_discount": 1, "hx_high_tax": 2, "hx_many": -1}),
}


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second prediction table: few ties, several models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("record_id"),
        F.col("source").alias("model"),
        (F.col("quality") == 0).alias("is_event"),
        F.col("n_chars").alias("score"),
    )


COHORT_SQL = """
lines AS (
  SELECT l_orderkey,
         bool_or(l_returnflag = 'R') AS hx_returned,
         bool_or(l_discount >= 0.08::DOUBLE) AS hx_deep_discount,
         bool_or(l_quantity >= 45) AS hx_bulk,
         bool_or(l_tax >= 0.07::DOUBLE) AS hx_high_tax,
         count(*) >= 6 AS hx_many,
         count(*) AS n_lines,
         max(l_quantity) AS max_quantity,
         CAST(min(l_shipdate) AS DATE) AS first_ship
  FROM lineitem GROUP BY l_orderkey),
cohort AS (
  SELECT o_orderkey AS record_id,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_totalprice >= 480000 THEN 'ZZ'
         WHEN o_totalprice >= 450000 THEN 'SZ' WHEN o_totalprice >= 300000 THEN 'MZ'
         ELSE 'MM' END AS genotype,
    CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE '(Missing)' END AS gender,
    CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'None' WHEN '4' THEN 'Passive Smoke as a Child'
      WHEN '3' THEN 'Passive Smoke as am Adult' WHEN '2' THEN 'Past' WHEN '1' THEN 'Current'
      END AS smoking_history_cigarette,
    CASE WHEN o_orderkey % 5 = 0 THEN '(Missing)'
         WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'Yes'
         ELSE 'No' END AS any_tobacco_exposure,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS date_of_birth,
    CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 10000, 2) END AS age_calculated,
    hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many, n_lines, max_quantity,
    CASE WHEN o_orderkey % 7 <> 0 THEN first_ship END AS date_received
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)"""

STUDY_SQL = COHORT_SQL + """,
study AS (
  SELECT *, genotype = 'ZZ' AS is_event, hx_bulk OR hx_many AS guideline
  FROM cohort
  WHERE genotype IS NOT NULL AND hx_returned IS NOT NULL AND hx_deep_discount IS NOT NULL
    AND hx_bulk IS NOT NULL AND hx_high_tax IS NOT NULL AND hx_many IS NOT NULL)"""

SCORED_SQL = STUDY_SQL + """,
scored AS (
  SELECT record_id, is_event, 'C0' AS card, guideline::INT AS score, -3.0 AS intercept, 1.0 AS multiplier FROM study
  UNION ALL
  SELECT record_id, is_event, 'C1', 3 * hx_returned::INT - 2 * hx_bulk::INT + 5 * hx_many::INT, -3.0, 1.0 FROM study
  UNION ALL
  SELECT record_id, is_event, 'C2', hx_deep_discount::INT + 2 * hx_high_tax::INT - hx_many::INT, -3.0, 2.0 FROM study)"""

DOCS_SQL = """
preds AS (
  SELECT l.doc_id AS record_id, d.source AS model, l.quality = 0 AS is_event, d.n_chars AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
