"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.session import settled, ship

__all__ = ["QUERIES", "ORACLES", "query", "docs_of", "fresh", "let", "row_key", "same", "settled", "words_of"]

#: Separators of words: space and \x09 to \x0D. Everything else is part of a word.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\f\r"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*cols: str | Column) -> Column:
    """A key that depends on the row's content alone, so a task that runs again gives the same one.

    Rows with equal content share a key. It is only used together with the id.
    """
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Equality of the named columns in which nulls are equal."""
    found = F.lit(True)
    for c in cols:
        found = found & left[c].eqNullSafe(right[c])
    return found


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")
