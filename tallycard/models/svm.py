"""Support vector machines with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycard.models.linear import LinearFit, balanced_weights, calibrated, fit_svm
from tallycard.operators.encode import assembled


@dataclass(frozen=True)
class SvmFit:
    """Margin model plus the curve that turns margins into probabilities."""

    features: list[str]
    curve: LinearFit
    linear: LinearFit | None = None
    expansion: object = None
    machine: object = None

    def with_margin(self, df: DataFrame) -> DataFrame:
        if self.linear:
            return df.withColumn("margin", self.linear.margin())
        expanded = self.expansion.transform(assembled(df, self.features))
        out = self.machine.transform(expanded)
        return out.withColumn("margin", vector_to_array("rawPrediction").getItem(1)).drop(
            "features", "expanded", "rawPrediction", "prediction")

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        out = self.with_margin(df).select(*keep, self.curve.p_event().alias("p_event"))
        return out.withColumn("pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))


def fit_svm_linear(rows: DataFrame, features: list[str], penalty: float = 0.1, balanced: bool = True,
                   steps: int = 100, tolerance: float = 1e-6) -> SvmFit:
    """``balanced``: without it a rare event gives a constant margin. The curve uses the true weights."""
    linear = fit_svm(balanced_weights(rows) if balanced else rows, features, penalty, steps, tolerance)
    return SvmFit(features, calibrated(rows, linear.margin()), linear=linear)


def fit_svm_poly(rows: DataFrame, features: list[str], degree: int, penalty: float = 0.1,
                 balanced: bool = True, steps: int = 100, tolerance: float = 1e-6) -> SvmFit:
    """All products of up to ``degree`` features as explicit new features."""
    expansion = PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded")
    expanded = expansion.transform(assembled(balanced_weights(rows) if balanced else rows, features))
    svc = LinearSVC(featuresCol="expanded", weightCol="weight", regParam=penalty, maxIter=steps, tol=tolerance)
    machine = svc.fit(expanded)
    draft = SvmFit(features, LinearFit(0.0, {}), expansion=expansion, machine=machine)
    return SvmFit(features, calibrated(draft.with_margin(rows), F.col("margin")), expansion=expansion, machine=machine)
