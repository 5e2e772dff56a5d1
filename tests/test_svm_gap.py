"""The dual bound: below every machine, close to the best one, and far from a bad one."""

import numpy as np
import planted
import pytest
from pyspark.sql import functions as F

from tallycard.models import svm, svm_gap
from tallycard.operators.encode import patterns, weighted_rows
from tallycard.session import settled

FEATURES = list("abcde")


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(planted.flags(3000)).withColumns({f: F.col(f).cast("int") for f in FEATURES})
    return settled(weighted_rows(patterns(df, FEATURES), FEATURES))


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_the_best_machine_is_proved_the_best(rows, degree):
    fit = svm.fit_svm_linear(rows, FEATURES) if degree == 1 else svm.fit_svm_poly(rows, FEATURES, degree)
    gap = svm_gap.svm_gap(rows, fit)
    assert gap.dual - 1e-9 <= gap.polished <= gap.primal + 1e-9 and gap.polished - gap.dual < 0.002
    assert gap.primal - gap.dual < 0.01  # the library's machine on these rows
    again = svm_gap.duality_gap(svm_gap.machine_table(rows, fit), gap.coefs, gap.intercept, 0.1)
    assert again.primal == pytest.approx(gap.polished, abs=1e-9)


def test_other_machines_are_not(rows):
    fit = svm.fit_svm_linear(rows, FEATURES)
    table = svm_gap.machine_table(rows, fit)
    best = svm_gap.svm_gap(rows, fit)
    constant = svm_gap.duality_gap(table, np.zeros(5), 0.3, 0.1)
    assert constant.dual == pytest.approx(best.dual, abs=1e-9) and constant.primal - constant.dual > 0.05
    rng = np.random.default_rng(1)
    x = np.array(table.select("x").toPandas().x.to_list())
    y, w = table.select("y", "w").toPandas().to_numpy(float).T
    for _ in range(200):
        b, c = rng.normal(size=5), rng.normal()
        spread = np.sqrt((w / w.sum()) @ (x - (w / w.sum()) @ x) ** 2 * w.sum() / (w.sum() - 1))
        assert (w / w.sum()) @ np.maximum(0, 1 - y * (x @ b + c)) + 0.05 * np.sum((b * spread) ** 2) >= best.dual - 1e-9


def test_constant_features(spark, rows):
    fit = svm.fit_svm_linear(rows.withColumn("e", F.lit(1)), FEATURES)
    gap = svm_gap.svm_gap(rows.withColumn("e", F.lit(1)), fit)
    assert -1e-9 <= gap.primal - gap.dual < 0.01
