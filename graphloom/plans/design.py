"""Queries of resolution, scenario, boundary and design operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import design, graph, relational, trace
from graphloom.plans.registry import query
from graphloom.plans.star import _context, _CONTEXT, _FACTS, _facts, _regions, _REGIONS, _SNAPSHOTS, _snapshots
from graphloom.sources import star


@query("b11_why_unresolved", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'parser_noise' WHEN event_id % 3 = 0 AND event_type = 'view' THEN 'intrinsic' WHEN user_id % 2 = 1 THEN 'ambiguous_symbol'
  WHEN event_id % 3 <> 0 AND event_type = 'click' THEN 'true_external' ELSE 'missing_target' END AS why FROM events""", graph=False)
def b11_why_unresolved(spark, d):
    e = star.table(spark, d, "events")
    callee = F.when(F.col("event_id") % 11 == 0, F.lit("1+2")).otherwise(F.col("event_type"))
    language = F.when(F.col("event_id") % 3 == 0, "fortran").otherwise("c")
    return e.select("event_id", design.why_unresolved(callee, language, 1 + F.col("user_id") % 2, ["view"], ["click"]).alias("why"))


@query("b15_guard_resolution", "SELECT p_partkey, CASE WHEN list_has_any(regexp_extract_all(p_name, '[A-Za-z_][A-Za-z0-9_]*'), ['red', 'gear']) THEN 'RUNTIME_DEPENDENT' ELSE 'UNKNOWN' END AS resolution FROM part", graph=False)
def b15_guard_resolution(spark, d):
    return star.table(spark, d, "part").select("p_partkey", design.guard_resolution(F.col("p_name"), ["red", "gear"]).alias("resolution"))


@query("b23_scenarios", """
, f AS (SELECT DISTINCT p_type AS family FROM part), g AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS guard FROM part WHERE p_size < 10)
SELECT p_partkey, family, CASE WHEN guard IS NULL THEN 'UNKNOWN' WHEN guard = family THEN 'TRUE' ELSE 'FALSE' END AS state FROM g, f""")
def b23_scenarios(spark, d):
    p = star.table(spark, d, "part")
    # scenarios are families: a short vocabulary, each guard is judged under each of them
    families = p.agg(F.array_sort(F.collect_set("p_type")).alias("families"))
    guards = p.where("p_size < 10").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("guard"))
    rows = guards.select("p_partkey", "guard", F.explode(families.scalar()).alias("family"))
    return rows.select("p_partkey", "family", design.scenario_state(F.col("guard"), F.col("family")).alias("state"))


@query("c7_same_file_first", """
, r AS (SELECT p_partkey AS ref, p_name AS name, p_brand AS brand FROM part), a AS (SELECT p_name AS name, p_brand AS brand, count(*) AS n, min('part:' || p_partkey) AS t FROM part GROUP BY ALL), b AS (SELECT p_name AS name, count(*) AS n, min('part:' || p_partkey) AS t FROM part WHERE p_size = 1 GROUP BY 1)
SELECT ref, CASE WHEN a.n = 1 THEN 'same_file' WHEN a.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'global_unique' WHEN b.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS tier,
  CASE WHEN a.n = 1 THEN 0.95 WHEN a.n > 1 THEN 0.0 WHEN b.n = 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN a.n = 1 THEN a.t WHEN a.n > 1 THEN NULL WHEN b.n = 1 THEN b.t END AS target
FROM r LEFT JOIN a USING (name, brand) LEFT JOIN b USING (name)""")
def c7_same_file_first(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), "p_size", star.node_id("part", "p_partkey").alias("target"))
    return relational.cascade(p.select("ref", "name", "brand"), [("same_file", 0.95, p, ["name", "brand"]), ("global_unique", 0.7, p.where("p_size = 1"), ["name"])], "ref")


@query("c11_include_targets", """
, f AS (SELECT path FROM nodes WHERE kind = 'CUSTOMER' AND ordinal % 3 <> 1)
, r AS (SELECT id, CASE WHEN ordinal % 2 = 0 THEN path ELSE 'elsewhere/' || name END AS target FROM nodes WHERE kind = 'CUSTOMER')
, b AS (SELECT string_split(path, '/')[-1] AS base, min(path) AS only_ FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT r.id, r.target, coalesce(f.path, b.only_) AS found FROM r LEFT JOIN f ON f.path = r.target LEFT JOIN b ON b.base = string_split(r.target, '/')[-1]""")
def c11_include_targets(spark, d):
    n = star.nodes(spark, d).where("kind = 'CUSTOMER'")
    refs = n.select("id", F.when(F.col("ordinal") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("elsewhere/"), "name")).alias("target"))
    return design.by_path_or_basename(refs, n.where("ordinal % 3 <> 1").select("path"))


@query("c12_best_candidate", """
, k AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 30), r AS (SELECT p_partkey, unnest([p_name || '.x', p_name, 'red ring']) AS name, unnest([0, 1, 2]) AS pos FROM part)
SELECT p_partkey, arg_min(name, pos) AS target FROM r JOIN k USING (name) GROUP BY p_partkey""")
def c12_best_candidate(spark, d):
    p = star.table(spark, d, "part")
    refs = p.select("p_partkey", F.array(F.concat("p_name", F.lit(".x")), F.col("p_name"), F.lit("red ring")).alias("candidates"))
    return design.best_candidate(refs, p.where("p_size > 30").select(F.col("p_name").alias("name")), "p_partkey", "candidates")


@query("c15_span_attribution", """
, spans AS (SELECT path, id, ordinal AS s, ordinal + 20 AS e FROM nodes WHERE kind = 'PART'), ev AS (SELECT path, ordinal + 3 AS line, language AS object FROM nodes WHERE kind = 'PART')
SELECT DISTINCT id, object FROM ev JOIN spans USING (path) WHERE line BETWEEN s AND e""")
def c15_span_attribution(spark, d):
    n = star.nodes(spark, d).where("kind = 'PART'")
    spans = n.select("path", "id", F.col("ordinal").alias("start"), (F.col("ordinal") + 20).alias("end"))
    events = n.select("path", (F.col("ordinal") + 3).alias("line"), F.col("language").alias("object"))
    return relational.covered(events, spans, "line").select("id", "object").distinct()


@query("c20_binding_chain", """
SELECT l_orderkey, l_partkey, o_custkey, c_nationkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""", graph=False)
def c20_binding_chain(spark, d):
    i = star.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = star.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return i.join(o, "l_orderkey", "left").join(c, "o_custkey", "left").select("l_orderkey", "l_partkey", "o_custkey", "c_nationkey")


@query("c26_bridges", """
SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN event_id % 2 = 0 ELSE false END AS valid FROM events""", graph=False)
def c26_bridges(spark, d):
    given = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("abi"), F.lit("link"))).otherwise(F.array(F.lit("abi")))
    required = spark.createDataFrame([("click", ["abi"]), ("view", ["abi", "link"]), ("error", ["none"])], "event_type string, needs array<string>")
    return design.bridged(star.table(spark, d, "events").select("event_id", "event_type", given.alias("given")), required, "event_id", "event_type", "given")


@query("d11_rejections", f"""{_REGIONS}
, e AS (SELECT a.unit AS su, b.unit AS du, weight FROM all_trades t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst)
, g AS (SELECT su AS unit, count_if(su <> du) AS crossing, count_if(weight % 5 = 0) AS open_ FROM e GROUP BY su)
SELECT unit, concat_ws(',', CASE WHEN crossing >= 100 THEN 'R3' END, CASE WHEN open_ >= 25 THEN 'R6' END) AS reasons FROM g""")
def d11_rejections(spark, d):
    m = _regions(spark, d)
    e = star.trades(spark, d).join(m.toDF("src", "su"), "src").join(m.toDF("dst", "du"), "dst")
    g = e.groupBy(F.col("su").alias("unit")).agg(F.count_if(F.col("su") != F.col("du")).alias("crossing"), F.count_if(F.col("weight") % 5 == 0).alias("open"))
    return design.rejections(g, "unit", {"R3": F.col("crossing") >= 100, "R6": F.col("open") >= 25})


@query("d16_mode_share", """
SELECT l_suppkey, round(max(n) / sum(n), 6) AS share FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""", graph=False)
def d16_mode_share(spark, d):
    n = star.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("d17_weighted_edges", """
, hub AS (SELECT dst FROM edges WHERE kind = 'USES' GROUP BY dst HAVING count(*) >= 640)
SELECT src, sum(CASE kind WHEN 'CALLS' THEN 1.0 ELSE 0.5 END * weight)::DOUBLE AS w FROM edges WHERE src LIKE 'order:%' AND dst NOT IN (SELECT dst FROM hub) GROUP BY src""")
def d17_weighted_edges(spark, d):
    e = star.edges(spark, d)
    hub = e.where("kind = 'USES'").groupBy("dst").agg(F.count("*").alias("n")).where("n >= 640").select("dst")
    w = F.when(F.col("kind") == "CALLS", 1.0).otherwise(0.5) * F.col("weight")
    return e.where("src LIKE 'order:%'").join(hub, "dst", "left_anti").groupBy("src").agg(F.sum(w).alias("w"))


@query("d22_memberships", "SELECT l_partkey, count(DISTINCT l_returnflag) AS scenarios, CASE WHEN count(DISTINCT l_returnflag) >= 2 THEN 'SHARED' ELSE 'SINGLE' END AS shared FROM lineitem GROUP BY l_partkey", graph=False)
def d22_memberships(spark, d):
    return design.memberships(star.table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("d24_stage_edges", f"{_REGIONS} SELECT a.unit AS src_stage, b.unit AS dst_stage, count(*) AS n, sum(weight)::BIGINT AS weight FROM all_trades t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst WHERE a.unit <> b.unit GROUP BY ALL")
def d24_stage_edges(spark, d):
    return design.stage_edges(star.trades(spark, d), _regions(spark, d))


@query("d26_module_ports", "SELECT p_type, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL", graph=False)
def d26_module_ports(spark, d):
    return relational.first_wins(star.table(spark, d, "part"), ["p_type", "p_name"], [F.col("p_partkey")]).select("p_type", "p_name", "p_partkey")


@query("d27_port_summary", "SELECT p_type, count(*) AS total, count_if(p_size % 2 = 0)::BIGINT AS inputs, count_if(p_size > 25)::BIGINT AS vectors FROM part GROUP BY p_type", graph=False)
def d27_port_summary(spark, d):
    return star.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("total"), F.count_if(F.col("p_size") % 2 == 0).alias("inputs"), F.count_if(F.col("p_size") > 25).alias("vectors"))


@query("d37_verdict_counts", f"SELECT truth, count_if(resolution = 'EXACT')::BIGINT AS confirmed, count_if(resolution <> 'EXACT')::BIGINT AS open FROM ({_FACTS}) GROUP BY truth", graph=False)
def d37_verdict_counts(spark, d):
    return _facts(spark, d).groupBy("truth").agg(F.count_if(F.col("resolution") == "EXACT").alias("confirmed"), F.count_if(F.col("resolution") != "EXACT").alias("open"))


@query("d45_plane_counts", """
, s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('A', 'N')), o AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('R', 'N'))
SELECT CASE WHEN s.o IS NULL THEN 'observed_only' WHEN o.o IS NULL THEN 'static_only' ELSE 'both' END AS plane, count(*) AS n FROM s FULL JOIN o ON s.o = o.o AND s.p = o.p GROUP BY 1""")
def d45_plane_counts(spark, d):
    i = star.table(spark, d, "lineitem")
    return relational.planes(i.where("l_returnflag IN ('A', 'N')"), i.where("l_returnflag IN ('R', 'N')"), ["l_orderkey", "l_partkey"]).groupBy("plane").agg(F.count("*").alias("n"))


@query("e8_ordinals", "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS seq FROM edges WHERE kind = 'CONTAINS'")
def e8_ordinals(spark, d):
    return trace.numbered(star.edges(spark, d).where("kind = 'CONTAINS'"), ["src"], ["dst"]).select("src", "dst", "seq")


@query("e9_dominant_child", "SELECT src, arg_max(dst, (weight, -length(dst), dst)) AS dst, max(weight) AS weight FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM all_trades) WHERE r = 1) GROUP BY src")
def e9_dominant_child(spark, d):
    return design.dominant_child(star.trades(spark, d))


@query("g8_gated_delta", f"{_SNAPSHOTS} SELECT coalesce(sa.o_orderkey, sb.o_orderkey) AS o_orderkey FROM sa FULL JOIN sb ON sa.o_orderkey = sb.o_orderkey WHERE sa.o_orderpriority IS DISTINCT FROM sb.o_orderpriority")
def g8_gated_delta(spark, d):
    # an order keeps its customer, so customers are groups of both snapshots
    return design.gated_delta(*_snapshots(spark, d), "o_custkey", "o_orderkey", "o_orderpriority")


@query("g10_marked_stale", f"""{_SNAPSHOTS}
SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT o_orderkey FROM sb) THEN 'UNBOUND' WHEN o_orderpriority = '1-URGENT' THEN 'STALE' ELSE 'KEPT' END AS mark FROM sa""")
def g10_marked_stale(spark, d):
    a, b = _snapshots(spark, d)
    return design.marked_stale(a.select("o_orderkey"), a.where("o_orderpriority = '1-URGENT'"), b, "o_orderkey")


@query("h3_path_status", """
, hops(id, n) AS (SELECT 'nation:0', 0 UNION SELECT t.dst, n + 1 FROM hops JOIN trades t ON t.src = id WHERE n < 2)
SELECT CASE WHEN bool_or(id = 'nation:24') THEN 'FOUND' WHEN bool_or(id IN (SELECT src FROM all_trades WHERE weight % 50 = 0)) THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS status FROM hops""")
def h3_path_status(spark, d):
    seeds = star.nodes(spark, d).where("id = 'nation:0'").select("id")
    reached = graph.bfs(star.strong_trades(spark, d), seeds, 2, "out")
    open_ = star.trades(spark, d).where("weight % 50 = 0").select(F.col("src").alias("id")).distinct()
    return design.path_status(reached, "nation:24", open_)


@query("h20_expand", "SELECT DISTINCT e.dst AS id FROM edges e WHERE e.src LIKE 'customer:%' AND e.kind = 'CALLS' AND e.dst NOT IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def h20_expand(spark, d):
    have = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select(star.node_id("order", "o_orderkey").alias("id"))
    return star.edges(spark, d).where("src LIKE 'customer:%' AND kind = 'CALLS'").select(F.col("dst").alias("id")).distinct().join(have, "id", "left_anti")


@query("h23_label_propagation")
def h23_label_propagation(spark, d):
    return design.propagated(star.strong_trades(spark, d), 5)


_TYPES = ", ty AS (SELECT id AS block, 't' || unnest(range(7)) AS token, CASE (ordinal + 1) % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'str' WHEN 2 THEN 'int' ELSE 'float' END AS type FROM nodes WHERE kind = 'NATION')"


@query("k3_p003", f"""{_CONTEXT}{_TYPES}
SELECT DISTINCT e.src, e.dst, e.token FROM e JOIN ty a ON a.block = e.src AND a.token = e.token JOIN ty b ON b.block = e.dst AND b.token = e.token
WHERE a.type <> 'UNKNOWN' AND b.type <> 'UNKNOWN' AND a.type <> b.type AND NOT (a.type = 'int' AND b.type = 'float')""")
def k3_p003(spark, d):
    c = _context(spark, d)
    kind = F.element_at(F.array(F.lit("UNKNOWN"), F.lit("str"), F.lit("int"), F.lit("float")), ((F.substring_index("block", ":", -1).cast("int") + 1) % 4 + 1).cast("int"))
    ok = spark.createDataFrame([("int", "float")], "a string, b string")
    return design.type_mismatches(c["edges"], c["ports"].withColumn("type", kind), ok).distinct()


@query("k11_c001", """
, claims AS (SELECT src, dst, CASE WHEN weight % 2 = 0 THEN 'MUST' ELSE 'MAY' END AS modality FROM all_trades), have AS (SELECT src, dst FROM trades)
SELECT c.src, c.dst, CASE WHEN h.src IS NOT NULL THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS status FROM claims c LEFT JOIN have h ON h.src = c.src AND h.dst = c.dst WHERE modality = 'MUST'""")
def k11_c001(spark, d):
    claims = star.trades(spark, d).select("src", "dst", F.when(F.col("weight") % 2 == 0, "MUST").otherwise("MAY").alias("modality"))
    return design.claim_support(claims, star.strong_trades(spark, d), ["src", "dst"], F.lit("COMPLETE"))


@query("k16_r003", "SELECT o_orderpriority || '/' || o_orderstatus AS resource, count(DISTINCT o_custkey) AS users FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1", graph=False)
def k16_r003(spark, d):
    return design.exclusive_uses(star.table(spark, d, "orders").withColumn("resource", F.concat_ws("/", "o_orderpriority", "o_orderstatus")), "resource", "o_custkey")


@query("k18_u002", f"SELECT event_id FROM ({_FACTS}) WHERE resolution = 'CANDIDATE_SET'", graph=False)
def k18_u002(spark, d):
    return _facts(spark, d).where("resolution = 'CANDIDATE_SET'").select("event_id")


@query("k19_u003", f"SELECT count(*) AS n FROM ({_FACTS}) WHERE truth = 'INFERRED' AND resolution = 'UNKNOWN' HAVING count(*) > 0", graph=False)
def k19_u003(spark, d):
    return _facts(spark, d).where("truth = 'INFERRED' AND resolution = 'UNKNOWN'").agg(F.count("*").alias("n")).where("n > 0")


@query("k22_derived_ports", f"{_CONTEXT} SELECT DISTINCT dst AS block, token, 'in' AS direction, 'INFERRED' AS truth FROM e")
def k22_derived_ports(spark, d):
    e = _context(spark, d)["edges"]
    return e.select(F.col("dst").alias("block"), "token", F.lit("in").alias("direction"), F.lit("INFERRED").alias("truth")).distinct()


@query("k36_design_state", """
SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') THEN 'EXPECTED' WHEN bool_or(l_returnflag = 'R') THEN 'NOT_EXPECTED' ELSE 'UNSPECIFIED' END AS state FROM lineitem GROUP BY l_partkey""", graph=False)
def k36_design_state(spark, d):
    kinds = F.collect_set("l_returnflag")
    has = lambda x: F.array_contains("kinds", x)
    by = star.table(spark, d, "lineitem").groupBy("l_partkey").agg(kinds.alias("kinds"))
    return by.select("l_partkey", F.when(has("A") & has("R"), "EXPECTED").when(has("R"), "NOT_EXPECTED").otherwise("UNSPECIFIED").alias("state"))


@query("m_d5_cube", "SELECT coalesce(l_returnflag, '*') AS l_returnflag, coalesce(l_linestatus, '*') AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", graph=False)
def m_d5_cube(spark, d):
    by = star.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return by.select(F.coalesce("l_returnflag", F.lit("*")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("*")).alias("l_linestatus"), "n")


@query("d41_declared_modules", f"""{_REGIONS}
SELECT coalesce(a.unit, '(unassigned)') AS src_unit, coalesce(b.unit, '(unassigned)') AS dst_unit, count(*) AS n FROM edges e LEFT JOIN member a ON a.id = e.src LEFT JOIN member b ON b.id = e.dst GROUP BY ALL""")
def d41_declared_modules(spark, d):
    m = _regions(spark, d)
    j = star.edges(spark, d).join(m.toDF("src", "su"), "src", "left").join(m.toDF("dst", "du"), "dst", "left")
    none = F.lit("(unassigned)")
    return j.groupBy(F.coalesce("su", none).alias("src_unit"), F.coalesce("du", none).alias("dst_unit")).agg(F.count("*").alias("n"))
