"""Decision trees, their rules, and forests."""

from __future__ import annotations

import re

from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycard.operators.encode import assembled

#: The deepest tree the library can grow.
DEEPEST = 30


def fit_tree(rows: DataFrame, features: list[str], depth: int | None = 7):
    """Tree of event shares; without a ``depth`` it grows as long as a split gains anything.

    Fitted as a regression of the 0/1 label, whose variance splits are the gini
    splits; a classification tree would merge neighbouring leaves of the same
    majority class and so lose their shares, all of them when events are rare.
    """
    return DecisionTreeRegressor(maxDepth=DEEPEST if depth is None else depth, weightCol="weight", seed=1).fit(assembled(rows, features))


def fit_forest(rows: DataFrame, features: list[str], trees: int = 120, mtry: int = 4, seed: int = 1, depth: int | None = None,
               bootstrap: bool = True):
    """Forest on single records, not patterns: a bootstrap of weighted patterns is not the same.

    Trees grow fully unless ``depth`` stops them. The predicted share is the mean
    of the trees' leaf shares, not the share of trees that vote for the event.
    """
    subset = str(min(mtry, len(features)))
    return RandomForestRegressor(
        numTrees=trees, featureSubsetStrategy=subset, seed=seed, maxDepth=DEEPEST if depth is None else depth,
        bootstrap=bootstrap).fit(assembled(rows, features))


def predicted(model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    out = model.transform(assembled(df, features)).select(*keep, F.col("prediction").alias("p_event"))
    return out.withColumn("pred_class", F.when(F.col("p_event") >= 0.5, "Abnormal").otherwise("Normal"))


def rule_conditions(model, features: list[str]) -> list[list[tuple[str, str, float]]]:
    """Root-to-leaf conditions (feature, operator, threshold) of a tree, leaf by leaf."""
    step = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)")
    path: list[tuple[int, tuple[str, str, float]]] = []
    rules: list[list[tuple[str, str, float]]] = []
    for line in model.toDebugString.splitlines():
        m = step.match(line)
        if m:
            depth = len(m.group(1))
            path = [p for p in path if p[0] < depth] + [
                (depth, (features[int(m.group(2))], m.group(3), float(m.group(4))))]
        elif "Predict:" in line:
            depth = len(line) - len(line.lstrip())
            rules.append([c for d, c in path if d < depth])
    return rules


def rule_text(conditions: list[tuple[str, str, float]]) -> str:
    return " AND ".join(f"{f} {op} {t:g}" for f, op, t in conditions) or "TRUE"


def rule_number(rules: list[list[tuple[str, str, float]]]) -> Column:
    """Number of the rule a record falls under (rules are disjoint)."""
    out = F.lit(None).cast("int")
    for i, conditions in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for f, op, t in conditions:
            x = F.col(f).cast("double")
            test = test & ((x <= t) if op == "<=" else (x > t))
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def rule_table(pats: DataFrame, rules: list[list[tuple[str, str, float]]]) -> DataFrame:
    """Each rule with its training rows and event share; ``pats`` as from ``patterns``."""
    counts = pats.groupBy(rule_number(rules).alias("rule_id")).agg(F.sum("n").alias("n"), F.sum("pos").alias("events"))
    texts = F.lit([rule_text(c) for c in rules])
    return counts.select(
        "rule_id", F.element_at(texts, F.col("rule_id")).alias("predicate"), "n", "events",
        (F.col("events") / F.col("n")).alias("p_event"))
