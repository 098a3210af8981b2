"""Snapshots of several tables: copied without what changed, written by partition, published last."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _put(rows: DataFrame, path: str, snapshot_id: str) -> None:
    """Replaces the one partition of a snapshot; the others stay. A second run after a failure writes the same."""
    named = rows.withColumn("snapshot_id", F.lit(snapshot_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def put(tables: Mapping[str, DataFrame], root: str, snapshot_id: str) -> None:
    """Writes the tables' partitions of a snapshot, then the line that publishes it: readers see all of it or nothing."""
    for name, rows in tables.items():
        _put(rows, f"{root}/{name}", snapshot_id)
    spark = next(iter(tables.values())).sparkSession
    _put(spark.range(1).select(F.lit(len(tables)).alias("tables")), f"{root}/published", snapshot_id)


def read(spark: SparkSession, root: str, name: str, snapshot_id: str) -> DataFrame:
    """A table of a published snapshot: only its partition is listed and read. An unpublished one has no rows."""
    done = F.col("snapshot_id") == snapshot_id
    if spark.read.parquet(f"{root}/published").where(done).isEmpty():
        return spark.read.parquet(f"{root}/{name}").where("false")
    return spark.read.parquet(f"{root}/{name}").where(done)


def copy(spark: SparkSession, root: str, parent: str, snapshot_id: str, fresh: Mapping[str, DataFrame], gone: DataFrame, keys: Mapping[str, Column]) -> None:
    """Makes a snapshot of a published parent: rows whose key (by table) is among gone (key) are left out, fresh rows added.

    What is unchanged is copied as it is, and nothing of the parent is touched.
    """
    made = {}
    out = gone.select(F.col("key").alias("key_")).distinct()
    for name, key in keys.items():
        kept = read(spark, root, name, parent).drop("snapshot_id").withColumn("key_", key).join(out, "key_", "left_anti").drop("key_")
        made[name] = kept.unionByName(fresh[name]) if name in fresh else kept
    put(made, root, snapshot_id)
