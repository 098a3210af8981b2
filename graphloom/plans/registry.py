"""Collects queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The star tables as nodes, edges and data events, in DuckDB's SQL.
GRAPH = """
WITH RECURSIVE places AS (
  SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey
), nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'REGION' AS kind, r_name AS name, r_name AS path, '' AS language, r_regionkey::BIGINT AS ordinal FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'NATION', n_name, place, '', n_nationkey FROM places
  UNION ALL SELECT 'customer:' || c_custkey, 'CUSTOMER', c_name, place || '/' || c_name, c_mktsegment, c_custkey FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPLIER', s_name, place || '/' || s_name, '', s_suppkey FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'PART', p_name, 'parts/' || p_type || '/' || p_brand, p_brand, p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'ORDER', o_orderkey::VARCHAR, 'orders/' || o_orderpriority, o_orderstatus, o_orderkey FROM orders
), raw_edges AS (
  SELECT 'CONTAINS' AS kind, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'CALLS', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'CALLS', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'USES', 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem
), edges AS (
  SELECT 'edge:' || kind || ':' || src || ':' || dst AS id, kind, src, dst, count(*) AS weight FROM raw_edges GROUP BY kind, src, dst
), all_trades AS (
  SELECT 'nation:' || s_nationkey AS src, 'nation:' || c_nationkey AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), trades AS (
  SELECT src, dst, weight FROM (SELECT *, sum(weight) OVER (PARTITION BY src) AS total FROM all_trades)
  WHERE src <> dst AND weight * 25 * 4 > total * 5
), data_events AS (
  SELECT user_id AS run, json_extract_string(props, '$.k') AS object, event_id, ts, event_type, value,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE' WHEN event_type = 'error' THEN 'READ_WRITE' ELSE 'READ' END AS op
  FROM events
)
"""


def query(name: str, sql: str | None = None, graph: bool = True) -> Callable[[Query], Query]:
    """Registers a query; sql is its twin, after the tables of GRAPH if graph is set."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (GRAPH + sql) if graph and not sql.lstrip().startswith(",") else (GRAPH.rstrip() + sql if graph else sql)
        return f

    return put
