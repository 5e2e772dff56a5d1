"""Models whose prediction is a weighted sum of features: fits and expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.functions.values import logistic
from tallycard.operators.encode import assembled


@dataclass(frozen=True)
class LinearFit:
    """Intercept and coefficients; predicts by plain expressions, without a UDF."""

    intercept: float
    coefs: dict[str, float]

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for name, value in self.coefs.items():
            total = total + F.col(f"`{name}`").cast("double") * F.lit(value)
        return total

    def p_event(self) -> Column:
        return logistic(self.margin())

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("(Intercept)", self.intercept), *self.coefs.items()]
        return spark.createDataFrame([(k, float(v)) for k, v in rows], "term string, estimate double")


def classed(df: DataFrame, keep: list[str], p_event: Column) -> DataFrame:
    """Prediction table: kept columns, p_event and the class at one half."""
    return df.select(*keep, p_event.alias("p_event")).withColumn(
        "pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))


def spreads(rows: DataFrame, features: list[str], weight: str | None) -> dict[str, float]:
    """Standard deviation of every feature, a weight of w counting as w records."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = {f: F.col(f).cast("double") for f in features}
    row = rows.agg(
        F.sum(w).alias("n"), *[F.sum(w * x[f]).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.sum(w * x[f] * x[f]).alias(f"q{i}") for i, f in enumerate(features)]).first()
    n = row["n"]
    return {
        f: (max(row[f"q{i}"] - row[f"s{i}"] ** 2 / n, 0.0) / max(n - 1, 1.0)) ** 0.5 for i, f in enumerate(features)
    }


def fit_logistic(rows: DataFrame, features: list[str], penalty: float = 0.0, label: str = "label",
                 weight: str | None = "weight") -> LinearFit:
    """Weighted logistic regression; ``penalty`` is the ridge strength on standardized features.

    Features are standardized here, since the library's own scaling does not
    treat a weight as that many records and would change the penalty.
    """
    scale = {f: 1.0 for f in features}
    if penalty:
        scale = {f: s or 1.0 for f, s in spreads(rows, features, weight).items()}
        rows = rows.withColumns({f: F.col(f).cast("double") / F.lit(scale[f]) for f in features})
    lr = LogisticRegression(
        labelCol=label, regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10)
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(assembled(rows, features))
    return LinearFit(
        float(model.intercept), {f: float(c) / scale[f] for f, c in zip(features, model.coefficients)})


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Give both classes the same total weight, for margins under a rare event."""
    totals = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    whole = sum(totals.values())
    share = F.lit(None).cast("double")
    for label, w in totals.items():
        share = F.when(F.col("label") == label, F.lit(whole / (len(totals) * w))).otherwise(share)
    return rows.withColumn("weight", F.col("weight") * share)


def fit_svm(rows: DataFrame, features: list[str], penalty: float = 0.1, steps: int = 100, tolerance: float = 1e-6) -> LinearFit:
    """Linear support vector machine; its margin is not a probability, see ``calibrated``."""
    svc = LinearSVC(weightCol="weight", regParam=penalty, maxIter=steps, tol=tolerance)
    model = svc.fit(assembled(rows, features))
    return LinearFit(float(model.intercept), dict(zip(features, map(float, model.coefficients))))


def calibrated(rows: DataFrame, margin: Column) -> LinearFit:
    """Logistic curve of the label over a margin (one feature named 'margin')."""
    counted = rows.select(margin.alias("margin"), "label", "weight").groupBy("margin", "label").agg(
        F.sum("weight").alias("weight"))
    return fit_logistic(counted, ["margin"])
