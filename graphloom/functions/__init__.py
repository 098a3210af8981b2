"""Small helpers that operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share.

    Without that setting only a local session gets a folder of its own machine; elsewhere each
    executor would write to its own disk, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = _own[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at_ = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes settled tables that no frame that is still used reads, and lets the shuffle files of finished jobs go.

    Spark deletes those once the driver's JVM has collected their plans, which a driver with room to spare puts off
    while a loop fills the disks; so the JVM is asked to.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_at_)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
