"""A yes/no rule used as a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_shares(train: DataFrame, rule: Column, event: str = "is_event") -> DataFrame:
    """Event share on either side of the rule: score 0/1 and risk."""
    return train.groupBy(rule.cast("int").alias("score")).agg(
        F.avg(F.col(event).cast("int")).alias("risk"), F.count("*").alias("n"))


def rule_predictions(test: DataFrame, rule: Column, shares: DataFrame, keep: list[str]) -> DataFrame:
    scored = test.select(*keep, rule.cast("int").alias("score"))
    joined = scored.join(F.broadcast(shares.select("score", F.col("risk").alias("p_event"))), "score", "left")
    return joined.withColumn("pred_class", F.when(F.col("score") == 0, "Normal").otherwise("Abnormal"))
