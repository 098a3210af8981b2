"""Further queries: scopes, bundles, reports, planned relations, incremental closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import settled, shared_path
from graphloom.operators import authority, design, diff, files, graph, relational, rollup, trace
from graphloom.plans.registry import query
from graphloom.plans.star import _context, _CONTEXT, _dag, _DAG, _FACTS, _facts, _regions, _REGIONS, _SNAPSHOTS, _snapshots
from graphloom.sources import star


@query("a13_load_json", "SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY p_type", graph=False)
def a13_load_json(spark, d):
    path = shared_path(spark, "artifact")
    star.table(spark, d, "part").select("p_type", F.struct("p_partkey", "p_size").alias("member")).write.json(path)
    back = spark.read.schema("p_type string, member struct<p_partkey:bigint,p_size:int>").json(path)
    return back.groupBy("p_type").agg(F.count("*").alias("n"), F.sum("member.p_size").alias("size"))


@query("a14_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", graph=False)
def a14_append(spark, d):
    path = shared_path(spark, "telemetry")
    e = star.table(spark, d, "events").select("event_id", "event_type")
    files.append(e.where("event_id % 2 = 0"), path)
    files.append(e.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("b12_open_calls", f"SELECT resolution, CASE WHEN resolution = 'EXACT' THEN 'RESOLVED' WHEN truth = 'HEURISTIC' THEN 'NO_EVIDENCE' WHEN resolution = 'CANDIDATE_SET' THEN 'SEVERAL_TARGETS' ELSE 'NO_TARGET' END AS reason, count(*) AS n FROM ({_FACTS}) GROUP BY ALL", graph=False)
def b12_open_calls(spark, d):
    reason = F.when(F.col("resolution") == "EXACT", "RESOLVED").when(F.col("truth") == "HEURISTIC", "NO_EVIDENCE").when(F.col("resolution") == "CANDIDATE_SET", "SEVERAL_TARGETS").otherwise("NO_TARGET")
    return _facts(spark, d).groupBy("resolution", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("b24_stage_state", """
SELECT p_type, CASE WHEN bool_or(p_brand = 'Brand#1') AND bool_or(p_size > 49) THEN 'ACTIVE' WHEN bool_or(p_brand = 'Brand#1') THEN 'MAY' ELSE 'INACTIVE' END AS state FROM part GROUP BY p_type""", graph=False)
def b24_stage_state(spark, d):
    by = star.table(spark, d, "part").groupBy("p_type").agg(F.bool_or(F.col("p_brand") == "Brand#1").alias("named"), F.bool_or(F.col("p_size") > 49).alias("sure"))
    return by.select("p_type", F.when(F.col("named") & F.col("sure"), "ACTIVE").when(F.col("named"), "MAY").otherwise("INACTIVE").alias("state"))


@query("c18_nearest_scope", """
, scope AS (SELECT id AS use_, id AS scope, string_split(path, '/') AS p, language AS name FROM nodes WHERE kind = 'CUSTOMER')
, anc AS (SELECT use_, name, array_to_string(p[1:i], '/') AS ancestor, len(p) - i AS depth FROM (SELECT *, unnest(range(1, len(p))) AS i FROM scope))
, dec AS (SELECT place AS ancestor, c_mktsegment AS name, 'customer:' || c_custkey AS target FROM customer JOIN places ON c_nationkey = n_nationkey WHERE c_acctbal > 9000
  UNION SELECT r_name, c_mktsegment, 'customer:' || c_custkey FROM customer JOIN places ON c_nationkey = n_nationkey WHERE c_acctbal < -500)
, f AS (SELECT use_, depth, count(DISTINCT target) AS n, min(target) AS target FROM anc JOIN dec USING (ancestor, name) GROUP BY ALL)
, b AS (SELECT use_, arg_min(n, depth) AS n, arg_min(target, depth) AS target FROM f GROUP BY use_)
SELECT s.use_ AS use, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n = 1 THEN 'EXACT' ELSE 'CANDIDATE_SET' END AS resolution, CASE WHEN n = 1 THEN target END AS target FROM scope s LEFT JOIN b ON b.use_ = s.use_""")
def c18_nearest_scope(spark, d):
    c = star.nodes(spark, d).where("kind = 'CUSTOMER'")
    uses = c.select(F.col("id").alias("use"), F.col("id").alias("scope"), F.col("language").alias("name"))
    up = c.select(F.col("id").alias("scope"), F.size(F.split("path", "/")).alias("size"), F.posexplode(rollup.ancestors(F.col("path"))).alias("pos", "ancestor"))
    up = up.select("scope", "ancestor", (F.col("size") - F.col("pos") - 1).alias("depth"))
    parts = F.split("path", "/")
    balance = star.table(spark, d, "customer").select(star.node_id("customer", "c_custkey").alias("id"), "c_acctbal")
    by = c.join(balance, "id")
    declared = by.where("c_acctbal > 9000").select(F.concat_ws("/", parts[0], parts[1]).alias("ancestor"), F.col("language").alias("name"), F.col("id").alias("target"))
    declared = declared.unionByName(by.where("c_acctbal < -500").select(parts[0].alias("ancestor"), F.col("language").alias("name"), F.col("id").alias("target")))
    return design.nearest_scope(uses, up, declared)


@query("c19_lookup", """
, m AS (SELECT p_brand, count(DISTINCT p_type) AS n, min(p_type) AS t FROM part WHERE p_size < 4 GROUP BY p_brand), b AS (SELECT DISTINCT p_brand FROM part)
SELECT b.p_brand, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n = 1 THEN 'EXACT' ELSE 'CANDIDATE_SET' END AS resolution FROM b LEFT JOIN m USING (p_brand)""")
def c19_lookup(spark, d):
    p = star.table(spark, d, "part")
    m = p.where("p_size < 4").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n"))
    return p.select("p_brand").distinct().join(m, "p_brand", "left").select("p_brand", F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") == 1, "EXACT").otherwise("CANDIDATE_SET").alias("resolution"))


@query("c21_actor_or_callee", "SELECT id FROM edges WHERE src = 'order:5' OR dst = 'supplier:5'")
def c21_actor_or_callee(spark, d):
    return star.edges(spark, d).where("src = 'order:5' OR dst = 'supplier:5'").select("id")


@query("c24_derived_calls", """
SELECT DISTINCT 'customer:' || o_custkey AS src, 'supplier:' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""", graph=False)
def c24_derived_calls(spark, d):
    o = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    i = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return o.join(i, "o_orderkey").select(star.node_id("customer", "o_custkey").alias("src"), star.node_id("supplier", "l_suppkey").alias("dst")).dropDuplicates()


@query("c28_bindings_between", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 7 OR (l_suppkey = 3 AND l_quantity > 45)", graph=False)
def c28_bindings_between(spark, d):
    return star.table(spark, d, "lineitem").where("l_partkey = 7 OR (l_suppkey = 3 AND l_quantity > 45)").select("l_orderkey", "l_partkey", "l_suppkey")


@query("d13_declared_relation", "SELECT l_suppkey, CASE count(DISTINCT p_type) WHEN 0 THEN 'UNRELATED' WHEN 1 THEN 'ALIGNED' WHEN 2 THEN 'CONFLICTING' ELSE 'CROSS_CUTTING' END AS relation FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size < 3 GROUP BY l_suppkey", graph=False)
def d13_declared_relation(spark, d):
    p = star.table(spark, d, "part").where("p_size < 3").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return design.declared_relation(star.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(p, "l_partkey"), "l_suppkey", "p_type")


@query("d15_concentration", "SELECT dst, round(max(weight) / sum(weight), 6) AS share FROM all_trades GROUP BY dst")
def d15_concentration(spark, d):
    return design.concentration(star.trades(spark, d))


@query("d30_extents", "SELECT p_type, count(*) AS objects, sum(p_size)::BIGINT AS elements, sum(p_size * 8)::BIGINT AS bytes FROM part GROUP BY p_type", graph=False)
def d30_extents(spark, d):
    return star.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("objects"), F.sum("p_size").alias("elements"), F.sum(F.col("p_size") * 8).alias("bytes"))


@query("d44_operations", "SELECT count_if(op = 'WRITE')::BIGINT AS writes, count_if(op = 'READ')::BIGINT AS reads, count_if(op = 'READ_WRITE')::BIGINT AS both FROM data_events")
def d44_operations(spark, d):
    is_ = lambda x: F.count_if(F.col("op") == x)
    return star.data_events(spark, d).agg(is_("WRITE").alias("writes"), is_("READ").alias("reads"), is_("READ_WRITE").alias("both"))


@query("e1_distinct", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name", graph=False)
def e1_distinct(spark, d):
    return relational.first_wins(star.table(spark, d, "part"), ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey")


@query("f5_finding_order", f"{_CONTEXT} SELECT rule, subject, token, row_number() OVER (ORDER BY rule, subject, token) - 1 AS seq FROM findings WHERE rule IN ('P001', 'R001')")
def f5_finding_order(spark, d):
    from graphloom.operators import rules

    found = rules.run(_context(spark, d), rules={k: rules.RULES[k] for k in ("P001", "R001")})
    return trace.numbered_everywhere(found, ["rule", "subject", "token"]).select("rule", "subject", "token", "seq")


@query("g5_field_changes", f"""{_SNAPSHOTS}
SELECT coalesce(sa.o_orderkey, sb.o_orderkey) AS o_orderkey, CASE WHEN sa.o_orderkey IS NULL THEN 'ADDED' WHEN sb.o_orderkey IS NULL THEN 'REMOVED' ELSE 'o_orderpriority' END AS changed
FROM sa FULL JOIN sb ON sa.o_orderkey = sb.o_orderkey WHERE sa.o_orderpriority IS DISTINCT FROM sb.o_orderpriority""")
def g5_field_changes(spark, d):
    return design.field_changes(*_snapshots(spark, d), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("g11_labelled_union", "SELECT id, min(source) AS source FROM (SELECT id, '1-name' AS source FROM nodes WHERE name LIKE 'red%' UNION ALL SELECT id, '2-path' FROM nodes WHERE path LIKE 'parts/ECONOMY%') GROUP BY id")
def g11_labelled_union(spark, d):
    n = star.nodes(spark, d)
    rows = n.where("name LIKE 'red%'").select("id", F.lit("1-name").alias("source")).unionByName(n.where("path LIKE 'parts/ECONOMY%'").select("id", F.lit("2-path").alias("source")))
    return rows.groupBy("id").agg(F.min("source").alias("source"))


@query("h5_boundary_edges", f"{_REGIONS} SELECT t.src, t.dst, t.weight FROM all_trades t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst WHERE (a.unit = 'ASIA') <> (b.unit = 'ASIA')")
def h5_boundary_edges(spark, d):
    m = _regions(spark, d)
    j = star.trades(spark, d).join(m.toDF("src", "su"), "src").join(m.toDF("dst", "du"), "dst")
    return j.where("(su = 'ASIA') <> (du = 'ASIA')").select("src", "dst", "weight")


@query("h18_invalidation", f"""{_SNAPSHOTS}
, changed AS (SELECT 'order:' || coalesce(sa.o_orderkey, sb.o_orderkey) AS id, CASE WHEN sa.o_orderkey IS NULL THEN 'ADDED' WHEN sb.o_orderkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS reason
  FROM sa FULL JOIN sb ON sa.o_orderkey = sb.o_orderkey WHERE sa.o_orderpriority IS DISTINCT FROM sb.o_orderpriority)
, up(id, reason, distance) AS (SELECT id, reason, 0 FROM changed UNION SELECT e.src, u.reason, u.distance + 1 FROM up u JOIN edges e ON e.dst = u.id)
, best AS (SELECT id, reason, min(distance) AS distance FROM up GROUP BY id, reason)
SELECT id, array_to_string(list_sort(list(reason)), ',') AS reasons, min(distance)::INTEGER AS distance FROM best GROUP BY id""")
def h18_invalidation(spark, d):
    """What depends on any changed order, how far away, and by which kinds of change."""
    changed = settled(diff.snapshot_diff(*_snapshots(spark, d), ["o_orderkey"], ["o_orderpriority"]), "changed")
    edges, out = star.edges(spark, d), None
    for reason in ("ADDED", "REMOVED", "CHANGED"):
        hit = graph.bfs(edges, changed.where(F.col("change") == reason).select(star.node_id("order", "o_orderkey").alias("id")), None, "in").withColumn("reason", F.lit(reason))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.min("distance").alias("distance"))


@query("k4_p004", f"""{_CONTEXT}
SELECT DISTINCT e.src, e.dst, e.token FROM e WHERE (string_split(e.src, ':')[2]::INTEGER % 6 = 0 AND e.token = 't1') OR (string_split(e.dst, ':')[2]::INTEGER % 6 <> 0 AND e.token = 't2')""")
def k4_p004(spark, d):
    c = _context(spark, d)
    number = F.substring_index("block", ":", -1).cast("int")
    gone = (F.col("direction") == "out") & (number % 6 == 0) & (F.col("token") == "t1") | (F.col("direction") == "in") & (number % 6 != 0) & (F.col("token") == "t2")
    return design.direction_violations(c["edges"], c["ports"].where(~gone)).distinct()


@query("k6_d002", "SELECT 'D002' AS rule, 'INFO' AS severity, 'UNKNOWN' AS status, '' AS subject, '' AS token WHERE (SELECT count(*) FROM lineitem WHERE l_quantity < 0) = 0", graph=False)
def k6_d002(spark, d):
    from graphloom.operators import rules

    e = star.table(spark, d, "lineitem").where("l_quantity < 0").select(F.lit("").alias("dst"), F.lit("").alias("token"), F.lit("").alias("src"))
    found = rules.finding(e, "D002", "INFO", F.col("dst"), F.col("token"))
    return rules.gate(found, e, "D002", "PARTIAL")


@query("k12_c002", f"""
, w(root, e, path, n) AS (SELECT src, dst, [src, dst], 2 FROM trades WHERE dst > src AND src LIKE 'nation:1%' UNION ALL
  SELECT w.root, t.dst, list_append(w.path, t.dst), w.n + 1 FROM w JOIN trades t ON t.src = w.e WHERE w.n < 3 AND t.dst > w.root AND t.dst LIKE 'nation:1%' AND NOT list_contains(w.path, t.dst))
SELECT array_to_string(path, '>') AS path FROM w WHERE list_aggregate(list_transform(path, lambda p: (p LIKE 'nation:1%')::INTEGER), 'min') = 1 AND EXISTS (SELECT 1 FROM trades t WHERE t.src = w.e AND t.dst = w.root)""")
def k12_c002(spark, d):
    scope = star.strong_trades(spark, d).where("src LIKE 'nation:1%' AND dst LIKE 'nation:1%'")
    return graph.cycles(scope, 3).select("path")


@query("k13_c003", """
, c AS (SELECT src, dst FROM all_trades WHERE weight % 3 = 0) SELECT src, dst, 'WARNING' AS severity FROM c WHERE (src, dst) NOT IN (SELECT src, dst FROM trades)""")
def k13_c003(spark, d):
    designed = star.trades(spark, d).where("weight % 3 = 0").select("src", "dst")
    return designed.join(star.strong_trades(spark, d).select("src", "dst"), ["src", "dst"], "left_anti").withColumn("severity", F.lit("WARNING"))


@query("k15_r002", f"{_REGIONS} SELECT DISTINCT unit, c_mktsegment AS resource FROM member JOIN customer ON id = 'customer:' || c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def k15_r002(spark, d):
    n = star.nodes(spark, d).where("kind = 'CUSTOMER'").select("id", F.col("language").alias("resource"))
    return _regions(spark, d).join(n, "id").where("resource NOT IN ('BUILDING', 'MACHINERY')").select("unit", "resource").distinct()


@query("k23_planned_relations", f"""{_DAG}
SELECT src, dst, CASE WHEN weight % 7 = 0 THEN 'NO_JUSTIFICATION' WHEN src LIKE 'nation:2%' THEN 'OUT_OF_SCOPE' ELSE 'OK' END AS reason FROM dag""")
def k23_planned_relations(spark, d):
    tests = [(F.col("weight") % 7 != 0, "NO_JUSTIFICATION"), (~F.col("src").startswith("nation:2"), "OUT_OF_SCOPE")]
    return _dag(spark, d).select("src", "dst", authority.first_failure(tests, "OK").alias("reason"))


@query("k28_resources", f"""{_REGIONS}
, a AS (SELECT DISTINCT unit, c_mktsegment AS r FROM member JOIN customer ON id = 'customer:' || c_custkey), p AS (SELECT DISTINCT unit, r FROM (SELECT DISTINCT unit FROM member), (SELECT unnest(['BUILDING', 'MACHINERY', 'NOTHING']) AS r))
SELECT coalesce(a.unit, p.unit) AS unit, coalesce(a.r, p.r) AS resource, CASE WHEN a.r IS NULL OR p.r IS NULL THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM a FULL JOIN p ON a.unit = p.unit AND a.r = p.r""")
def k28_resources(spark, d):
    m = _regions(spark, d)
    actual = m.join(star.nodes(spark, d).where("kind = 'CUSTOMER'").select("id", F.col("language").alias("resource")), "id").select("unit", "resource")
    planned = m.select("unit").distinct().select("unit", F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("NOTHING"))).alias("resource"))
    return diff.expectations(planned, actual, m, ["unit", "resource"], "unit")


@query("k35_runtime_state", """
SELECT t.src, t.dst, CASE WHEN weight % 3 = 0 THEN 'OBSERVED' WHEN weight % 2 = 0 THEN 'NOT_OBSERVED' ELSE 'UNMEASURED' END AS state FROM all_trades t""")
def k35_runtime_state(spark, d):
    t = star.trades(spark, d)
    return authority.states(t, t.where("weight % 3 = 0"), ["src", "dst"], F.col("weight") % 2 == 0, "OBSERVED", "NOT_OBSERVED", "UNMEASURED")
