"""Numeric coding of predictors, learned on training rows and applied to any."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column with more levels is no category, unless a caller says so.
MOST_LEVELS = 1000


def levels_present(df: DataFrame, column: str, order: list[str] | None = None, most: int | None = MOST_LEVELS) -> list[str]:
    """Levels that occur, in the given order or sorted.

    Each level becomes a column, so they reach the driver. ``most`` guards
    against coding a free text: with more levels it is an error, None is no bound.
    """
    distinct = df.select(column).dropna().distinct()
    seen = [r[0] for r in (distinct if most is None else distinct.limit(most + 1)).collect()]
    if most is not None and len(seen) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return [v for v in order if v in seen] if order else sorted(seen)


def with_reference(levels: list[str], reference: str) -> list[str]:
    """Levels with the reference one first, which ``dummy_columns`` leaves out."""
    return [reference, *[v for v in levels if v != reference]] if reference in levels else list(levels)


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct value among the rows, from one aggregate."""
    ends = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).first()
    return [c for c in columns if ends[c]["lo"] == ends[c]["hi"]]


def dummy_columns(column: str, levels: list[str], full: bool = False) -> dict[str, Column]:
    """0/1 columns named <column>_<level>; the first level is the reference unless ``full``.

    A missing value and a level that is not among ``levels`` are NULL in all of them.
    """
    known = F.col(column).isin(levels)
    return {
        f"{column}_{lv}": F.when(known, (F.col(column) == lv).cast("int"))
        for lv in (levels if full else levels[1:])
    }


@dataclass
class Encoder:
    """Fit on training rows, then turn any rows into 0/1 and numeric features.

    Columns in ``carry`` (ids, labels, other roles) pass through untouched. A
    level not seen in training is coded NULL. ``most_levels`` see ``levels_present``.
    """

    columns: list[str]
    carry: list[str] = field(default_factory=list)
    full: bool = False
    drop_constant: bool = True
    most_levels: int | None = MOST_LEVELS
    level_order: dict[str, list[str]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    kept: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame) -> "Encoder":
        constant = constant_columns(train, self.columns) if self.drop_constant else []
        self.kept = [c for c in self.columns if c not in constant]
        types = dict(train.dtypes)
        self.levels = {
            c: levels_present(train, c, self.level_order.get(c), self.most_levels) for c in self.kept if types[c] == "string"
        }
        return self

    @property
    def features(self) -> list[str]:
        names: list[str] = []
        for c in self.kept:
            names += self.coded(c)
        return names

    def coded(self, c: str) -> list[str]:
        """Features that a kept column becomes."""
        return [f"{c}_{lv}" for lv in (self.levels[c] if self.full else self.levels[c][1:])] if c in self.levels else [c]

    def transform(self, df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        out: list[Column] = []
        for c in self.kept:
            if c in self.levels:
                out += [e.alias(n) for n, e in dummy_columns(c, self.levels[c], self.full).items()]
            else:
                out.append(F.col(c).cast("int").alias(c) if types[c] == "boolean" else F.col(c))
        return df.select(*self.carry, *out)


def patterns(df: DataFrame, features: list[str], event: str = "is_event", keys: list[str] = ()) -> DataFrame:
    """Distinct feature patterns with their number of rows (n) and of events (pos).

    With p yes/no features there are at most 2^p of them, whatever the number
    of rows; counting is map-side, so a frequent pattern is no hot key.
    """
    return df.groupBy(*keys, *features).agg(
        F.sum(F.col(event).cast("long")).alias("pos"), F.count("*").alias("n"))


def weighted_rows(pats: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Patterns as (label, weight) rows for the weighted fits."""
    both = F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("pos")).cast("double").alias("weight")),
    ))
    return pats.select(*keys, *features, both).filter("weight > 0")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(
        df.withColumns({f: F.col(f).cast("double") for f in features}))
