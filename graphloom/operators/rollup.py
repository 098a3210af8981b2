"""Aggregations: statistics, roll-ups, consensus, boundaries, accuracy, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, key, n: counts of nodes by kind and language, and of edges by kind."""
    by = lambda rows, what, col: rows.groupBy(F.lit(what).alias("what"), F.col(col).alias("key")).agg(F.count("*").alias("n"))
    return by(nodes, "node_kind", "kind").unionByName(by(nodes, "language", "language")).unionByName(by(edges, "edge_kind", "kind"))


def ancestors(path: Column) -> Column:
    """Every proper prefix of a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def prefix_counts(nodes: DataFrame) -> DataFrame:
    """Nodes below each directory, at every level."""
    return nodes.select(F.explode(ancestors(F.col("path"))).alias("directory")).groupBy("directory").agg(F.count("*").alias("n"))


def overview(edges: DataFrame, member: DataFrame) -> DataFrame:
    """src_unit, dst_unit, kind, n: edges between the units of their ends (member: id, unit)."""
    a = edges.join(member.toDF("src", "src_unit"), "src").join(member.toDF("dst", "dst_unit"), "dst")
    return a.groupBy("src_unit", "dst_unit", "kind").agg(F.count("*").alias("n"))


def witnesses(rows: DataFrame, keys: Sequence[str], witness: Column, keep: int = 3) -> DataFrame:
    """How many rows stand behind each key, and the first few of them in order: no more than those are held."""
    w = rows.select(*keys, witness.alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    first = w.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("w"))).where(F.col("r") <= keep)
    first = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("first"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(first, list(keys))


def hubs(edges: DataFrame, nodes: DataFrame, least: int, names: Sequence[str]) -> DataFrame:
    """id, fan_in: targets of many edges, and nodes whose name holds a hub word."""
    fan = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    named = nodes.select("id", F.lower("name").rlike("|".join(names)).alias("named"))
    rows = named.join(fan, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), "named")
    return rows.where((F.col("fan_in") >= least) | F.col("named"))


def boundary(edges: DataFrame, member: DataFrame) -> DataFrame:
    """unit, kind, internal, outgoing, incoming: edges inside and across the boundary of each unit."""
    units = edges.join(member.toDF("src", "su"), "src", "left").join(member.toDF("dst", "du"), "dst", "left")
    ends = F.array(F.struct(F.col("su").alias("unit"), F.lit("out").alias("side")), F.struct(F.col("du").alias("unit"), F.lit("in").alias("side")))
    rows = units.select("kind", F.coalesce(F.col("su") == F.col("du"), F.lit(False)).alias("inside"), F.explode(ends).alias("e")).where("e.unit IS NOT NULL")
    return rows.groupBy(F.col("e.unit").alias("unit"), "kind").agg(
        F.count_if(F.col("inside") & (F.col("e.side") == "out")).alias("internal"),
        F.count_if(~F.col("inside") & (F.col("e.side") == "out")).alias("outgoing"),
        F.count_if(~F.col("inside") & (F.col("e.side") == "in")).alias("incoming"),
    )


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: the standard modularity of a partition of a weighted directed graph's undirected form."""
    w = edges.join(member.toDF("src", "su"), "src").join(member.toDF("dst", "du"), "dst")
    inside = w.groupBy(F.col("su").alias("unit")).agg(F.sum(F.when(F.col("su") == F.col("du"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("out"))
    into = w.groupBy(F.col("du").alias("unit")).agg(F.sum("weight").alias("into"))
    total = w.agg(F.sum("weight").alias("m"))
    both = inside.join(into, "unit", "full_outer").withColumn("m", total.scalar())
    z = lambda c: F.coalesce(c, F.lit(0))
    term = z("inside") / F.col("m") - F.pow((z("out") + z("into")) / (2 * F.col("m")), 2)
    return both.agg(F.round(F.sum(term), 9).alias("modularity"))


def consensus(rows: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Each dimension's only value, or UNKNOWN where claims differ; never a vote."""
    agree = [F.when(F.min(d) == F.max(d), F.min(d)).otherwise("UNKNOWN").alias(d) for d in dimensions]
    return rows.groupBy(*keys).agg(*agree)


def reconcile(claims: DataFrame, slot: Sequence[str], variant: str, provider: str) -> DataFrame:
    """slot, status, variants, providers: one variant is EVIDENCE, several are a CONFLICT."""
    by = claims.groupBy(*slot).agg(F.count_distinct(variant).alias("variants"), F.count_distinct(provider).alias("providers"))
    return by.select(*slot, F.when(F.col("variants") == 1, "EVIDENCE").otherwise("CONFLICT").alias("status"), "variants", "providers")


def overall(rows: DataFrame, status: str, precedence: Sequence[str]) -> DataFrame:
    """One row: the first status in the order of precedence that occurs."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(precedence) for x in (p, i)]), F.col(status))
    return rows.agg(F.min_by(status, rank).alias("overall"))


def accuracy(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision and recall of predicted keys."""
    e, a = expected.select(*keys).distinct().withColumn("e", F.lit(1)), actual.select(*keys).distinct().withColumn("a", F.lit(1))
    n = e.join(a, list(keys), "full_outer").agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"),
    )
    return n.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def digest(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, n, digest: a digest of each group's rows that ignores their order.

    Row hashes are combined by sums, so that no group is collected.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long"))
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[part(i).alias(f"p{i}") for i in range(4)])
    return by.select(*keys, "n", F.sha2(F.concat_ws(":", "n", "p0", "p1", "p2", "p3"), 256).alias("digest"))
