"""Differences between snapshots, plans and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, change: ADDED, REMOVED or CHANGED rows (equal rows are left out)."""
    side = lambda rows, name: rows.select(*keys, F.xxhash64(*fields).alias(f"{name}_h"), F.struct(*fields).alias(name))
    both = side(before, "a").join(side(after, "b"), list(keys), "full_outer")
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(~F.col("a").eqNullSafe(F.col("b")), "CHANGED")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def delta_units(before: DataFrame, after: DataFrame, key: str, aspects: dict[str, str]) -> DataFrame:
    """key, unit: SYMBOL_ADDED, SYMBOL_REMOVED, and one unit for each changed aspect.

    aspects: unit name to column.
    """
    a = before.select(key, *[F.col(c).alias(f"a_{c}") for c in aspects.values()], F.lit(1).alias("in_a"))
    b = after.select(key, *[F.col(c).alias(f"b_{c}") for c in aspects.values()], F.lit(1).alias("in_b"))
    both = a.join(b, key, "full_outer")
    here = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    units = [F.when(F.col("in_a").isNull(), "SYMBOL_ADDED"), F.when(F.col("in_b").isNull(), "SYMBOL_REMOVED")]
    units += [F.when(here & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), unit) for unit, c in aspects.items()]
    return both.select(key, F.explode(F.array_compact(F.array(*units))).alias("unit"))


def expectations(expected: DataFrame, actual: DataFrame, bound: DataFrame, keys: Sequence[str], object_col: str) -> DataFrame:
    """keys, status: MATCH, MISMATCH (missing or unexpected), or UNBOUND where the object is not bound."""
    e, a = expected.select(*keys).distinct().withColumn("e", F.lit(1)), actual.select(*keys).distinct().withColumn("a", F.lit(1))
    known = bound.select(F.col(object_col)).distinct().withColumn("k", F.lit(1))
    rows = e.join(a, list(keys), "full_outer").join(known, object_col, "left")
    status = F.when(F.col("k").isNull(), "UNBOUND").when(F.col("e").isNull() | F.col("a").isNull(), "MISMATCH").otherwise("MATCH")
    return rows.select(*keys, status.alias("status"))


def dangling(rows: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """reference, n: how many values of each reference column are not among the ids they name."""
    out = None
    for column, ids in refs.items():
        lost = rows.join(ids.select(F.col("id").alias(column)), column, "left_anti").agg(F.count("*").alias("n")).select(F.lit(column).alias("reference"), "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def similarity(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """key, jaccard of the two sides' sets of items."""
    a = left.select(key, item).distinct().withColumn("a", F.lit(1))
    b = right.select(key, item).distinct().withColumn("b", F.lit(1))
    both = a.join(b, [key, item], "full_outer").groupBy(key).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("i"), F.count("*").alias("u"))
    return both.select(key, F.round(F.col("i") / F.col("u"), 6).alias("jaccard"))
