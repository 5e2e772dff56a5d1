"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own.

    ``checkpoint_dir`` is where intermediate tables go when the session names no folder itself.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallycard")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYCARD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    if checkpoint_dir and not SparkConf().contains("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, str(f.relative_to(home.parent)))
    # apart from the scratch tables, as executors that join later fetch it too
    target = f"{shared_dir(spark).rstrip('/')}/{home.name}-package-{app}/{home.name}.zip"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as spark.checkpoint.dir names it.

    In local mode with nothing set, a folder below the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallycard-checkpoint"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table written and read back within one job chain.

    All paths of a session share one folder, see ``clear_scratch``.
    """
    home = f"{shared_dir(spark).rstrip('/')}/tallycard-{spark.sparkContext.applicationId}"
    return f"{home}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Used where several later branches must see the very same rows, or where an
    iteration would otherwise grow its lineage without end. The table is
    columnar, so each branch reads only its columns, and its size on disk is
    known to the optimizer, which therefore broadcasts it only when it is below
    spark.sql.autoBroadcastJoinThreshold.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's settled tables; DataFrames built on them are void afterwards."""
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "any")).getParent()
    home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(home, True)
