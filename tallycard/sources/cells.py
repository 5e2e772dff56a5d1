"""Cells of an experiment that are stored in several tables and appear in all of them or in none.

A cell's tables are written under a run number of their own, read back, and
only then named in a manifest, by one row in one file. Readers follow the
manifest, so what a broken run left behind is never seen, and a cell that is
written again takes the place of the old one at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard.sources.tables import read_or_empty

MANIFEST = "_published"


def _columns(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def manifest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The run that counts for every published cell; a row per cell."""
    ddl = ", ".join([*[f"{n} string" for n in names], "run string", "rows map<string, bigint>", "published timestamp"])
    rows = read_or_empty(spark, f"{path}/{MANIFEST}", ddl)
    return rows.groupBy(*names).agg(F.max_by(F.struct("run", "rows"), F.struct("published", "run")).alias("last")).select(*names, "last.*")


def publish(found: dict[str, DataFrame], path: str, cell: dict[str, str]) -> None:
    """Write the tables of one cell, check that readers find every row, and publish it."""
    run, written = uuid.uuid4().hex, {}
    spark = next(iter(found.values())).sparkSession
    marks = {**{n: F.lit(v) for n, v in cell.items()}, "run": F.lit(run)}
    for table, df in found.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).withColumns(marks).write.mode("append").partitionBy(*marks).parquet(f"{path}/{table}")
        written[table] = seen.get["n"]
    for table, n in written.items():
        # a table without rows has no folder
        stored = read_or_empty(spark, f"{path}/{table}", T.StructType([T.StructField(c, T.StringType()) for c in marks]))
        back = stored.filter(F.col("run") == run).count()
        if back != n:
            raise RuntimeError(f"{table}: {back} of {n} rows of {cell} are stored")
    fields = T.StructType([*[T.StructField(n, T.StringType()) for n in cell], T.StructField("run", T.StringType()),
                           T.StructField("rows", T.MapType(T.StringType(), T.LongType()))])
    entry = spark.createDataFrame([(*cell.values(), run, written)], fields).withColumn("published", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")


def published(spark: SparkSession, path: str, table: str, schema: T.StructType | str, names: list[str]) -> DataFrame:
    """The rows of all published cells, an empty table if there is none."""
    columns = _columns(schema)
    stored = read_or_empty(spark, f"{path}/{table}", T.StructType([*columns.fields, T.StructField("run", T.StringType())]))
    # one row per cell
    return stored.join(F.broadcast(manifest(spark, path, names).select(*names, "run")), [*names, "run"], "left_semi").select(*columns.names)
