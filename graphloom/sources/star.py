"""The star tables as an evidence graph: nodes, edges, snapshots and data events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _node(rows: DataFrame, kind: str, key: str, name, path, language) -> DataFrame:
    return rows.select(
        node_id(kind, key).alias("id"), F.lit(kind.upper()).alias("kind"), name.alias("name"), path.alias("path"),
        language.alias("language"), F.col(key).cast("long").alias("ordinal"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, n_name, r_name, place: the path of each nation."""
    # 25 nations and 5 regions, at any scale
    region = F.broadcast(table(spark, sf_dir, "region"))
    joined = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.withColumn("place", F.concat_ws("/", "r_name", "n_name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, path, language, ordinal of regions, nations, customers, suppliers, parts and orders."""
    place = F.broadcast(places(spark, sf_dir))
    none = F.lit("")
    customer = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    inside = lambda name: F.concat_ws("/", "place", name)
    parts = [
        _node(table(spark, sf_dir, "region"), "region", "r_regionkey", F.col("r_name"), F.col("r_name"), none),
        _node(place, "nation", "n_nationkey", F.col("n_name"), F.col("place"), none),
        _node(customer, "customer", "c_custkey", F.col("c_name"), inside("c_name"), F.col("c_mktsegment")),
        _node(supplier, "supplier", "s_suppkey", F.col("s_name"), inside("s_name"), none),
        _node(table(spark, sf_dir, "part"), "part", "p_partkey", F.col("p_name"), F.concat_ws("/", F.lit("parts"), "p_type", "p_brand"), F.col("p_brand")),
        _node(table(spark, sf_dir, "orders"), "order", "o_orderkey", F.col("o_orderkey").cast("string"), F.concat_ws("/", F.lit("orders"), "o_orderpriority"), F.col("o_orderstatus")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edge(rows: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """Edges between (kind of node, key) of both ends; grouped by the keys, so filters on them reach the scan, and named last."""
    by = rows.groupBy(src[1], dst[1]).agg(F.count("*").alias("weight"))
    return by.select(F.lit(kind).alias("kind"), node_id(*src).alias("src"), node_id(*dst).alias("dst"), "weight")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: line items by supplier's nation and customer's nation, all pairs."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seller = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = items.join(buyer.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    by = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("weight"))
    return by.select(node_id("nation", "s_nationkey").alias("src"), node_id("nation", "c_nationkey").alias("dst"), "weight")


def strong_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades between different nations that exceed a quarter above their source's mean: a small cyclic digraph."""
    rows = trades(spark, sf_dir)
    total = rows.groupBy("src").agg(F.sum("weight").alias("total"))
    return rows.join(total, "src").where("src <> dst AND weight * 25 * 4 > total * 5").select("src", "dst", "weight")


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: parts that follow one another among an order's lines of more than 42 pieces, by day; a
    digraph with cycles that grows with the tables."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 42").select("l_orderkey", "l_partkey", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey")
    pairs = rows.select("l_partkey", F.lead("l_partkey").over(w).alias("next")).where("next IS NOT NULL AND next <> l_partkey")
    return pairs.groupBy("l_partkey", "next").agg(F.count("*").alias("weight")).select(node_id("part", "l_partkey").alias("src"), node_id("part", "next").alias("dst"), "weight")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, src, dst, weight: CONTAINS, CALLS and USES, unique by (kind, src, dst)."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = [
        _edge(nation, "CONTAINS", ("region", "n_regionkey"), ("nation", "n_nationkey")),
        _edge(customer, "CONTAINS", ("nation", "c_nationkey"), ("customer", "c_custkey")),
        _edge(supplier, "CONTAINS", ("nation", "s_nationkey"), ("supplier", "s_suppkey")),
        _edge(orders, "CALLS", ("customer", "o_custkey"), ("order", "o_orderkey")),
        _edge(items, "CALLS", ("order", "l_orderkey"), ("part", "l_partkey")),
        _edge(items, "USES", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
    ]
    return reduce(DataFrame.unionByName, parts).select(F.concat_ws(":", F.lit("edge"), "kind", "src", "dst").alias("id"), "kind", "src", "dst", "weight")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, src, dst: the edges as the tables tell them, with repeats; nothing is grouped, so walks prune the scans."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    one = lambda rows, kind, src, dst: rows.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"))
    parts = [
        one(nation, "CONTAINS", node_id("region", "n_regionkey"), node_id("nation", "n_nationkey")),
        one(customer, "CONTAINS", node_id("nation", "c_nationkey"), node_id("customer", "c_custkey")),
        one(supplier, "CONTAINS", node_id("nation", "s_nationkey"), node_id("supplier", "s_suppkey")),
        one(orders, "CALLS", node_id("customer", "o_custkey"), node_id("order", "o_orderkey")),
        one(items, "CALLS", node_id("order", "l_orderkey"), node_id("part", "l_partkey")),
        one(items, "USES", node_id("order", "l_orderkey"), node_id("supplier", "l_suppkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def snapshot(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """The orders of a date range as a snapshot: id, path, digest."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")))
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def data_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, object, event_id, ts, op: events as accesses to data objects."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "WRITE").when(F.col("event_type") == "error", "READ_WRITE").otherwise("READ")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.get_json_object("props", "$.k").alias("object"), "event_id", "ts", op.alias("op"), "event_type", "value"
    )
