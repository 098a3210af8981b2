"""Differences between a design and the baseline that it was forked from, by origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import settled


def origins(rows: DataFrame) -> DataFrame:
    """id, origin: the end of each row's chain of origins (id, origin_id), null where it has none; ends need no row.

    Pointers jump to where their target points, so a chain of n forks takes about log n rounds. A ring of
    origins has no end: its rows have no origin.
    """
    at = settled(rows.where("origin_id IS NOT NULL AND origin_id <> id").select("id", F.col("origin_id").alias("at")).distinct(), "origins")
    rounds = max(1, at.count().bit_length())
    for _ in range(rounds):
        new = at.join(at.select(F.col("id").alias("at"), F.col("at").alias("next")), "at", "left")
        new = settled(new.select("id", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "origins")
        at = new.select("id", "at")
        if new.where("moved").isEmpty():
            break
    open_ = at.join(at.select(F.col("id").alias("at")).distinct(), "at", "left_semi").select("id")
    return rows.select("id").distinct().join(at.join(open_, "id", "left_anti").withColumnRenamed("at", "origin"), "id", "left")


def _listed(a: str, b: str, name: str):
    """Items of array a that array b has not, sorted and joined."""
    return F.array_join(F.array_sort(F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))), ",").alias(name)


def changes(before: dict[str, DataFrame], after: dict[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """change, subject, old, new: components added, removed, modified and moved, relations added and removed, mappings changed.

    Both sides: components (id, parent and the fields; after also origin, the baseline's id or null),
    relations (kind, src, dst), mappings (id, entity). A component may be modified and moved at once. Of
    several components of one origin the least id stands for it. A parent without a counterpart is a move.
    Relations meet by kind and the origins of both ends; those of ends without one are added.
    """
    base = settled(before["components"], "baseline")
    work = after["components"].join(base.select(F.col("id").alias("origin"), F.lit(True).alias("known_")), "origin", "left")
    work = settled(work.withColumn("origin", F.when(F.col("known_"), F.col("origin"))).drop("known_"), "working")
    none = F.lit(None).cast("string")
    told = lambda rows, change, subject, old=none, new=none: rows.select(F.lit(change).alias("change"), subject.alias("subject"), old.alias("old"), new.alias("new"))
    first = work.where("origin IS NOT NULL").groupBy("origin").agg(F.min_by(F.struct("id", "parent", *fields), "id").alias("w"))
    out = told(work.where("origin IS NULL"), "component_added", F.col("id"))
    out = out.unionByName(told(base.join(first.select(F.col("origin").alias("id")), "id", "left_anti"), "component_removed", F.col("id")))

    both = base.select(F.col("id").alias("origin"), F.struct("parent", *fields).alias("b")).join(first, "origin")
    differs = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"w.{f}")), f) for f in fields])), ",")
    out = out.unionByName(told(both.where(differs != ""), "component_modified", F.col("w.id"), new=differs))
    # a parent that is no working component, or has no origin, is another one than before
    parents = work.select(F.col("id").alias("wp"), F.col("origin").alias("wp_origin")).distinct()
    placed = both.withColumn("wp", F.col("w.parent")).join(parents, "wp", "left")
    moved = F.when(F.col("wp").isNull(), F.col("b.parent").isNotNull()).otherwise(~F.coalesce(F.col("wp_origin") == F.col("b.parent"), F.lit(False)))
    out = out.unionByName(told(placed.where(moved), "component_moved", F.col("w.id"), F.col("b.parent"), F.col("wp")))

    name = F.concat_ws("|", "kind", "src", "dst")
    ends = work.select("id", "origin").distinct()
    rel = after["relations"].distinct().join(ends.toDF("src", "so"), "src", "left").join(ends.toDF("dst", "do"), "dst", "left")
    old = before["relations"].select("kind", F.col("src").alias("so"), F.col("dst").alias("do")).distinct()
    kept = rel.where("so IS NOT NULL AND do IS NOT NULL").select("kind", "so", "do").distinct()
    new = rel.join(old.withColumn("there_", F.lit(True)), ["kind", "so", "do"], "left").where("there_ IS NULL")
    out = out.unionByName(told(new, "relation_added", name))
    gone = old.join(kept, ["kind", "so", "do"], "left_anti")
    out = out.unionByName(told(gone, "relation_removed", F.concat_ws("|", "kind", "so", "do")))

    # the mappings of a component are few: they are compared as sets
    sets = lambda rows, c: rows.groupBy("id").agg(F.collect_set("entity").alias(c))
    m = first.select(F.col("origin"), F.col("w.id").alias("id")).join(sets(after["mappings"], "wm"), "id", "left")
    m = m.join(sets(before["mappings"], "bm").withColumnRenamed("id", "origin"), "origin", "left")
    m = m.select("id", _listed("bm", "wm", "gone"), _listed("wm", "bm", "come")).where("gone <> '' OR come <> ''")
    return out.unionByName(told(m, "mapping_changed", F.col("id"), F.col("gone"), F.col("come")))
