"""Stored tables: reading, writing, and resuming a grid of experiments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard.session import settled


def read_cohort_csv(spark: SparkSession, path: str, schema: T.StructType, date_pattern: str = "M/d/yyyy") -> DataFrame:
    """Header row, given types; dates that do not parse become NULL."""
    return spark.read.schema(schema).options(header=True, dateFormat=date_pattern, mode="PERMISSIVE").csv(path)


def typed_lines(lines: DataFrame, column: str, ddl: str, date_pattern: str = "M/d/yyyy") -> DataFrame:
    """The same parser over lines of text that are already a column."""
    parsed = F.from_csv(F.col(column), ddl, {"dateFormat": date_pattern})
    return lines.select(parsed.alias("r")).select("r.*")


def write_table(df: DataFrame, path: str, partitions: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The stored table, or an empty one with the same columns."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_cell(df: DataFrame, path: str, cell: list[str]) -> None:
    """Store one experiment cell; writing the same cell again replaces it."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cell).parquet(path)
    )


def rounded(df: DataFrame, columns: list[str], digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def write_csv(df: DataFrame, path: str, digits: int = 8) -> None:
    """CSV with a header; floating point columns rounded."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    rounded(df, doubles, digits).write.mode("overwrite").option("header", True).csv(path)


def pending_cells(grid: DataFrame, finished: DataFrame, cell: list[str]) -> DataFrame:
    """Cells of the grid without stored results."""
    return grid.join(finished.select(*cell).distinct(), cell, "left_anti")


def complete_cells(results: DataFrame, cell: list[str]) -> DataFrame:
    """Rows of cells that hold as many rows as the fullest cell; adds ``count``.

    Sizes are counted first and joined back, so no cell is held in one task.
    """
    sizes = settled(results.groupBy(*cell).agg(F.count("*").alias("count")))
    largest = sizes.agg(F.max("count")).scalar()
    return results.join(sizes.filter(F.col("count") == largest), cell)


def check_complete(results: DataFrame, cell: list[str], expected: int) -> None:
    """Raise unless every cell holds ``expected`` rows."""
    off = results.groupBy(*cell).agg(F.count("*").alias("count")).filter(F.col("count") != expected)
    bad = off.limit(5).collect()  # only for the message
    if bad:
        raise ValueError(f"cells with another number of rows than {expected}: {bad}")


