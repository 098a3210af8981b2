"""Queries of judgements: alignment of claims, planned changes, runtime scopes, topology, path verdicts, all rules at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import settled
from graphloom.operators import authority, design, graph, rules
from graphloom.plans.compared import _EXPOSED, _FULL, _ITEMS, _exposure, _full_context
from graphloom.plans.deeper import _RETURNS, _returns
from graphloom.plans.registry import query
from graphloom.sources import star


@query("d33_alignments", """
WITH c AS (SELECT l_orderkey, l_linestatus = 'F' AS canonical, l_returnflag AS variant, CASE WHEN l_discount = 0 THEN 'UNKNOWN' ELSE 'EXACT' END AS resolution FROM lineitem)
, g AS (SELECT l_orderkey, count_if(canonical) AS nc, count_if(NOT canonical) AS nr, count_if(canonical AND resolution = 'UNKNOWN') AS nu, count(DISTINCT variant) FILTER (WHERE canonical) AS vc, count(DISTINCT variant) FILTER (WHERE NOT canonical) AS vr,
    len(list_intersect(list(variant) FILTER (WHERE canonical), list(variant) FILTER (WHERE NOT canonical))) AS common FROM c GROUP BY l_orderkey)
SELECT l_orderkey, 'CANONICAL_ADMISSION' AS label, 'CANONICAL_CANDIDATE' AS authority, nc::BIGINT AS items FROM g WHERE nc > 0
UNION ALL SELECT l_orderkey, CASE WHEN vc = 1 THEN 'CORROBORATION' ELSE 'PROVIDER_CONFLICT' END, 'CANONICAL_CANDIDATE', nc::BIGINT FROM g WHERE nc > 1
UNION ALL SELECT l_orderkey, 'REFERENCE_DISAGREEMENT', 'REFERENCE_EVIDENCE', nr::BIGINT FROM g WHERE nr > 1 AND vr > 1
UNION ALL SELECT l_orderkey, CASE WHEN nu > 0 THEN 'UNKNOWN_PRESERVED' WHEN common > 0 THEN 'CORROBORATION' ELSE 'CANONICAL_REFERENCE_DISCREPANCY' END, 'MIXED', (CASE WHEN nu > 0 THEN nr ELSE nc + nr END)::BIGINT FROM g WHERE nc > 0 AND nr > 0""", graph=False)
def d33_alignments(spark, d):
    """The lines of an order are claims of one slot: finished ones canonical, by what came of them; without discount unknown."""
    c = star.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linestatus") == "F").alias("canonical"), F.col("l_returnflag").alias("variant"), F.when(F.col("l_discount") == 0, "UNKNOWN").otherwise("EXACT").alias("resolution"))
    return authority.alignments(c, ["l_orderkey"])


_PLANNED = """
WITH x AS (SELECT o_orderstatus, 'claim:' || l_orderkey || ':' || l_linenumber AS id, 'part:' || l_partkey AS src, 'part:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS dst, l_returnflag || l_linestatus AS kind,
  CASE WHEN l_tax > 0 THEN 'tax' END AS justification, CASE WHEN l_discount > 0 THEN 'discount' ELSE '' END AS support, l_linestatus, l_quantity, l_suppkey, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
, r AS (SELECT * FROM x WHERE o_orderstatus = 'P'), fd AS (SELECT DISTINCT dst AS src, src AS dst FROM x WHERE o_orderstatus = 'F')
, old AS (SELECT src, arg_max(kind, (l_quantity, id)) AS before FROM x WHERE o_orderstatus = 'F' GROUP BY src)
, ok AS (SELECT 'supplier:' || s_suppkey AS path FROM supplier WHERE s_acctbal > 0), cyc AS (SELECT count(*) > 0 AS c FROM (SELECT src FROM r WHERE src = dst UNION ALL SELECT a.src FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src))
SELECT id AS subject, 'TARGET_MISSING' AS "check", 'ERROR' AS severity FROM r WHERE dst IS NULL UNION ALL SELECT id, 'ILLEGAL_DIRECTION', 'ERROR' FROM r WHERE (src, dst) IN (SELECT src, dst FROM fd WHERE src IS NOT NULL)
UNION ALL SELECT id, 'FORBIDDEN_RELATION', 'ERROR' FROM r WHERE kind = 'RO' UNION ALL SELECT id, 'UNSUPPORTED', 'UNKNOWN' FROM r WHERE justification IS NULL OR support = ''
UNION ALL SELECT id, 'INTERFACE_MISMATCH', 'ERROR' FROM r JOIN old USING (src) WHERE before <> kind AND p_type <> 'SMALL'
UNION ALL SELECT DISTINCT id, 'SCOPE_CONTRADICTION', 'ERROR' FROM r WHERE 'supplier:' || l_suppkey NOT IN (SELECT path FROM ok) UNION ALL SELECT '', 'CYCLE', 'ERROR' FROM cyc WHERE c"""


@query("k23_planned_findings", _PLANNED, graph=False)
def k23_planned_findings(spark, d):
    """Pending orders plan that parts follow one another; finished ones tell what is forbidden the other way round."""
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber")
    ident = F.concat_ws(":", F.lit("claim"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    x = star.table(spark, d, "lineitem").join(o, "l_orderkey").join(p, "l_partkey").withColumn("next", F.lead("l_partkey").over(w))
    x = x.select(
        "o_orderstatus", "p_type", "l_quantity", "l_suppkey", ident.alias("id"), star.node_id("part", "l_partkey").alias("src"), star.node_id("part", "next").alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("kind"),
        F.when(F.col("l_tax") > 0, "tax").alias("justification"), F.when(F.col("l_discount") > 0, "discount").otherwise("").alias("support"),
    )
    x = settled(x, "plans")
    r, done = x.where("o_orderstatus = 'P'"), x.where("o_orderstatus = 'F'")
    old = done.groupBy("src").agg(F.max_by("kind", F.struct("l_quantity", "id")).alias("before"))
    interfaces = r.join(old, "src").select("id", "before", F.col("kind").alias("after"), F.when(F.col("p_type") == "SMALL", "adapter").alias("adapter"))
    allowed = star.table(spark, d, "supplier").where("s_acctbal > 0").select(star.node_id("supplier", "s_suppkey").alias("path"))
    back = done.where("dst IS NOT NULL").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return design.planned_findings(r, interfaces, r.select("id", star.node_id("supplier", "l_suppkey").alias("path")), allowed, ["RO"], back)


_RUNTIME = """
WITH x AS (SELECT 'order:' || l_orderkey || ':' || l_linenumber AS relation, 'supplier:' || l_suppkey AS run, l_returnflag AS kind, 'customer:' || o_custkey AS src, 'part:' || l_partkey AS dst, o_orderstatus AS revision, o_orderpriority AS build, l_linestatus, l_quantity, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
, rn AS (SELECT run, any_value(l_suppkey) AS l_suppkey, arg_max(revision, (l_quantity, l_orderkey, l_linenumber)) AS revision, arg_max(build, (l_quantity, l_orderkey, l_linenumber)) AS build, arg_max(kind, (l_quantity, l_orderkey, l_linenumber)) AS covered_kind, arg_max(src, (l_quantity, l_orderkey, l_linenumber)) AS covered_src FROM x GROUP BY run)
, r AS (SELECT rn.*, CASE WHEN s_nationkey < 23 THEN 'EXACT' ELSE 'LOOSE' END AS binding, CASE WHEN s_acctbal > -900 THEN s_name END AS w, CASE WHEN s_acctbal > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS integrity FROM rn JOIN supplier ON s_suppkey = l_suppkey)
, e AS (SELECT DISTINCT run, src, dst FROM x WHERE l_linestatus = 'F')
, j AS (SELECT x.relation, x.run, x.kind, x.src, CASE WHEN r.revision <> x.revision THEN 'revision_missing_or_mismatch' WHEN r.build <> x.build THEN 'build_missing_or_mismatch' WHEN binding <> 'EXACT' THEN 'scenario_binding_not_exact' WHEN w IS NULL THEN 'trace_window_unavailable' END AS reason,
    e.run IS NOT NULL AS seen, integrity = 'COMPLETE' AS whole, integrity = 'COMPLETE' AND covered_kind = x.kind AND covered_src = x.src AS covered FROM x JOIN r USING (run) LEFT JOIN e ON e.run = x.run AND e.src = x.src AND e.dst = x.dst)
SELECT relation, run, CASE WHEN reason IS NOT NULL THEN 'UNMEASURED' WHEN seen THEN 'OBSERVED' WHEN covered THEN 'NOT_OBSERVED' ELSE 'UNMEASURED' END AS state,
  coalesce(reason, CASE WHEN seen AND NOT whole THEN 'trace_integrity_partial' WHEN seen THEN '' WHEN covered THEN 'bounded_workload_and_trace_window_only' ELSE 'relation_trace_coverage_not_complete' END) AS limits FROM j"""


@query("k35_runtime_scopes", _RUNTIME, graph=False)
def k35_runtime_scopes(spark, d):
    """Order lines ask the run of their supplier, which has the revision and build of its largest line; its finished lines are its edges."""
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderstatus").alias("revision"), F.col("o_orderpriority").alias("build"))
    relation = F.concat_ws(":", F.lit("order"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    x = star.table(spark, d, "lineitem").join(o, "l_orderkey").withColumns({"relation": relation, "run": star.node_id("supplier", "l_suppkey"), "kind": F.col("l_returnflag"), "src": star.node_id("customer", "o_custkey"), "dst": star.node_id("part", "l_partkey")})
    most = lambda c, name: F.max_by(c, F.struct("l_quantity", "l_orderkey", "l_linenumber")).alias(name)
    rn = x.groupBy("run", "l_suppkey").agg(most("revision", "revision"), most("build", "build"), most("kind", "covered_kind"), most("src", "covered_src"))
    s = star.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_nationkey") < 23, "EXACT").otherwise("LOOSE").alias("binding"), F.when(F.col("s_acctbal") > -900, F.col("s_name")).alias("window"),
        F.when(F.col("s_acctbal") > 0, "COMPLETE").otherwise("PARTIAL").alias("integrity"), F.lit("COMPLETE").alias("covered"),
    )
    return authority.runtime_states(x.select("relation", "run", "kind", "src", "dst", "revision", "build"), rn.join(s, "l_suppkey"), x.where("l_linestatus = 'F'").select("run", "src", "dst"), ["revision", "build"])


@query("h5_topology", """
, arc AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)
, s0 AS (SELECT 'customer:7' AS id, 0 AS distance), s1 AS (SELECT * FROM s0 UNION ALL SELECT DISTINCT dst, 1 FROM arc WHERE src IN (SELECT id FROM s0) AND dst NOT IN (SELECT id FROM s0)), seen AS MATERIALIZED (SELECT * FROM s1 UNION ALL SELECT DISTINCT dst, 2 FROM arc WHERE src IN (SELECT id FROM s1) AND dst NOT IN (SELECT id FROM s1))
SELECT 'node' AS part, id, kind, NULL AS src, NULL AS dst, distance::INTEGER AS distance FROM nodes JOIN seen USING (id)
UNION ALL SELECT CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'edge' ELSE 'boundary' END, e.id, e.kind, e.src, e.dst, least(a.distance, b.distance)::INTEGER FROM edges e LEFT JOIN seen a ON a.id = e.src LEFT JOIN seen b ON b.id = e.dst WHERE e.kind IN ('CALLS', 'USES') AND (a.id IS NOT NULL OR b.id IS NOT NULL)""")
def h5_topology(spark, d):
    """What stands around a customer within two steps, with calls and uses inside and across the boundary."""
    edges = star.links(spark, d)
    return graph.topology_of(edges.distinct(), star.nodes(spark, d), spark.createDataFrame([("customer:7",)], "id string"), 2, ["CALLS", "USES"])


@query("h3_path_verdicts", """
, pr AS (SELECT 'customer:' || c_custkey AS source, 'part:' || p_partkey AS target FROM customer JOIN part ON p_partkey = c_custkey OR p_partkey = c_custkey + 1 WHERE c_acctbal < 0
  UNION SELECT 'customer:' || o_custkey, 'part:' || min(l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 GROUP BY o_custkey)
, w AS (SELECT o_custkey, o_orderkey, l_partkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal < 0), gap AS (SELECT DISTINCT 'customer:' || o_custkey AS source FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
, hit AS (SELECT DISTINCT 'customer:' || o_custkey AS source, 'part:' || l_partkey AS target FROM w)
SELECT source, target, CASE WHEN hit.source IS NOT NULL THEN 'FOUND' WHEN source IN (SELECT source FROM gap) THEN 'PARTIAL' ELSE 'UNKNOWN' END AS verdict, CASE WHEN hit.source IS NOT NULL THEN 2 END AS hops FROM pr LEFT JOIN hit USING (source, target)""")
def h3_path_verdicts(spark, d):
    """Do customers in debt reach a part by calls? Their urgent pending orders may lead to more than is known."""
    c = star.table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    p = star.table(spark, d, "part").select("p_partkey")
    two = c.select("c_custkey", F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("p_partkey")).join(p, "p_partkey")
    o = star.table(spark, d, "orders")
    i = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    bought = o.join(i, "o_orderkey").join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.min("l_partkey").alias("p"))
    pairs = two.select(star.node_id("customer", "c_custkey").alias("source"), star.node_id("part", "p_partkey").alias("target")).unionByName(bought.select(star.node_id("customer", "o_custkey").alias("source"), star.node_id("part", "p").alias("target")))
    open_ = o.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(star.node_id("order", "o_orderkey").alias("id"))
    return graph.path_verdicts(star.links(spark, d).where("kind = 'CALLS'"), pairs.distinct(), 2, open_)


def _every(spark, d) -> DataFrame:
    found = list(_exposure(spark, d).values())
    cycles = graph.long_cycles(_returns(spark, d), 12).where("nodes > 2")
    found.append(cycles.select(F.lit("C002").alias("rule"), F.lit("WARNING").alias("severity"), F.lit("VIOLATION").alias("status"), F.col("path").alias("subject"), F.lit("").alias("token")))
    none = star.table(spark, d, "lineitem").where("l_quantity < 0").select(F.lit("").alias("subject"), F.lit("").alias("token"))
    found.append(rules.gate(rules.finding(none, "D002", "INFO", F.col("subject"), F.col("token")), none, "D002", "PARTIAL"))
    rows = reduce(DataFrame.unionByName, [f.select("rule", "severity", "status", "subject", "token") for f in found])
    told = rows.groupBy("rule", "severity", "status").agg(F.count("*").alias("n"), F.min("subject").alias("first"))
    told = told.unionByName(rules.run_summary(_full_context(spark, d), rules.FULL_RULES))
    # a rule may tell findings of one kind in both
    return told.groupBy("rule", "severity", "status").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


_BORDERS = _EXPOSED[_EXPOSED.index(_ITEMS) + len(_ITEMS) :]
_CYCLES = _RETURNS[_RETURNS.index("ret AS") :]


@query("k21_every_rule", f"""{_ITEMS}{_BORDERS}, {_CYCLES}
SELECT rule, severity, status, count(*) AS n, min(subject) AS first FROM (
  SELECT * FROM ({_FULL})
  UNION ALL SELECT rule, 'WARNING', 'VIOLATION', subject, token FROM bf
  UNION ALL SELECT 'C002', 'WARNING', 'VIOLATION', path, '' FROM cyc WHERE nodes > 2
  UNION ALL SELECT 'D002', 'INFO', 'UNKNOWN', '', '' WHERE (SELECT count(*) FROM lineitem WHERE l_quantity < 0) = 0) GROUP BY ALL""", graph=False)
def k21_every_rule(spark, d):
    """All rules in one run: how many findings of each, and the first subject."""
    return _every(spark, d)


# -- flows, operations, bindings -------------------------------------------------------------------


@query("h20_flows", """
, rt AS (SELECT 'flow:' || c_nationkey AS flow, 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < -900), ok AS (SELECT id FROM nodes WHERE kind IN ('CUSTOMER', 'ORDER') OR (kind = 'PART' AND path LIKE 'parts/SMALL%'))
, call AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS'), b1 AS (SELECT DISTINCT flow, dst AS id FROM rt JOIN call ON src = rt.id WHERE dst IN (SELECT id FROM ok)), b2 AS (SELECT DISTINCT flow, dst AS id FROM b1 JOIN call ON src = b1.id WHERE dst IN (SELECT id FROM ok))
, bl AS (SELECT flow, id, 0 AS r FROM rt UNION ALL SELECT flow, id, 1 FROM b1 UNION ALL SELECT flow, id, 2 FROM b2)
SELECT flow, 'block' AS part, id, NULL AS src, NULL AS dst, r::INTEGER AS round FROM bl UNION ALL SELECT a.flow, 'net', a.id || '>' || b.id, a.id, b.id, greatest(a.r, b.r)::INTEGER FROM bl a JOIN call ON call.src = a.id JOIN bl b ON b.flow = a.flow AND b.id = call.dst""")
def h20_flows(spark, d):
    """A flow for each nation: its customers deep in debt, their orders, and of the parts of these the small ones."""
    c = star.table(spark, d, "customer").where("c_acctbal < -900")
    roots = c.select(F.concat(F.lit("flow:"), F.col("c_nationkey").cast("string")).alias("flow"), star.node_id("customer", "c_custkey").alias("id"))
    nodes = star.nodes(spark, d).withColumn("kind", F.when((F.col("kind") == "PART") & ~F.col("path").startswith("parts/SMALL"), "OTHER").otherwise(F.col("kind")))
    return design.flows(roots, star.links(spark, d), nodes, ["CUSTOMER", "ORDER", "PART"], 2)


@query("c21_operations", """
, s AS (SELECT 'customer:' || c_custkey AS symbol FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT symbol, id, CASE sum(n) WHEN 1 THEN 'actor' WHEN 2 THEN 'callee' ELSE 'both' END AS role FROM (SELECT src AS symbol, id, 1 AS n FROM edges WHERE src IN (SELECT symbol FROM s) UNION SELECT dst, id, 2 FROM edges WHERE dst IN (SELECT symbol FROM s)) GROUP BY symbol, id""")
def c21_operations(spark, d):
    """What customers in debt and urgent orders do, and what goes to them."""
    c = star.table(spark, d, "customer").where("c_acctbal < 0").select(star.node_id("customer", "c_custkey").alias("symbol"))
    o = star.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(star.node_id("order", "o_orderkey").alias("symbol"))
    return design.operations_of(c.unionByName(o), star.edges(spark, d).select("id", F.col("src").alias("actor"), F.col("dst").alias("callee")))


@query("c28_pair_bindings", """
WITH pr AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R')
SELECT 'supplier:' || l_suppkey AS caller, 'part:' || l_partkey AS callee, l_orderkey, l_linenumber, l_returnflag AS port FROM lineitem WHERE (l_suppkey, l_partkey) IN (SELECT l_suppkey, l_partkey FROM pr)""", graph=False)
def c28_pair_bindings(spark, d):
    """All deliveries between suppliers and parts of which an urgent one came back."""
    i = star.table(spark, d, "lineitem")
    bindings = i.select(star.node_id("supplier", "l_suppkey").alias("caller"), star.node_id("part", "l_partkey").alias("callee"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("port"))
    urgent = star.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return design.bindings_between(bindings, bindings.where("port = 'R'").join(urgent, "l_orderkey", "left_semi"))


@query("d23_assembled_flow", """
WITH cm AS (SELECT r_name AS app, s_name AS command, s_suppkey, CASE WHEN s_acctbal > 0 THEN n_name END AS fam FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
, c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY app, fam) > 1 THEN fam END AS family FROM cm), ini AS (SELECT DISTINCT r_name AS app FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal < -990)
, cl AS (SELECT l_suppkey, p_brand || '-' || p_size AS callee, bool_and(l_discount < 0.08) AS resolved FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_brand <> 'Brand#1' GROUP BY ALL)
, m AS (SELECT app, command, family, callee, resolved FROM c JOIN cl ON l_suppkey = s_suppkey), b AS (SELECT app, callee, CASE WHEN count(DISTINCT family) > 1 THEN 'shared' WHEN bool_and(resolved) THEN 'callee' ELSE 'unknown' END AS k FROM m GROUP BY ALL)
, a AS (SELECT DISTINCT app, CASE WHEN app IN (SELECT app FROM ini) THEN 'OBSERVED' ELSE 'DERIVED' END AS seen FROM c)
, e AS (SELECT app, 'flow' AS kind, 'entry:' || app AS src, 'init:' || app AS dst, seen AS truth, 'ACTIVE' AS resolution FROM a UNION ALL SELECT app, 'flow', 'init:' || app, 'dispatch:' || app, seen, 'ACTIVE' FROM a UNION ALL SELECT app, 'flow', 'dispatch:' || app, 'exit:' || app, 'DERIVED', 'ACTIVE' FROM a
  UNION ALL SELECT DISTINCT app, 'guard', 'dispatch:' || app, 'region:' || app || ':' || family, 'DERIVED', 'UNKNOWN' FROM c WHERE family IS NOT NULL
  UNION ALL SELECT app, 'flow', CASE WHEN family IS NULL THEN 'dispatch:' || app ELSE 'region:' || app || ':' || family END, 'command:' || app || ':' || command, 'DERIVED', CASE WHEN family IS NULL THEN 'UNKNOWN' ELSE 'ACTIVE' END FROM c
  UNION ALL SELECT app, 'call', 'command:' || app || ':' || command, k || ':' || app || ':' || callee, 'OBSERVED', CASE WHEN resolved THEN 'EXACT' ELSE 'UNKNOWN' END FROM m JOIN b USING (app, callee))
, n AS (SELECT app, unnest(['entry', 'init', 'dispatch', 'exit']) AS kind, unnest(['entry:' || app, 'init:' || app, 'dispatch:' || app, 'exit:' || app]) AS id, unnest(['OBSERVED', 'DERIVED', 'OBSERVED', 'DERIVED']) AS truth FROM a
  UNION ALL SELECT DISTINCT app, 'region', 'region:' || app || ':' || family, 'DERIVED' FROM c WHERE family IS NOT NULL UNION ALL SELECT app, 'command', 'command:' || app || ':' || command, 'OBSERVED' FROM c UNION ALL SELECT app, k, k || ':' || app || ':' || callee, 'OBSERVED' FROM b)
SELECT app, 'node' AS part, kind, id, NULL AS src, NULL AS dst, truth, NULL AS resolution FROM n UNION ALL SELECT app, 'edge', kind, src || '>' || dst, src, dst, truth, resolution FROM e""", graph=False)
def d23_assembled_flow(spark, d):
    """Regions are apps, suppliers commands, nations families (of those not in debt); what came back is called."""
    place = star.places(spark, d)
    s = star.table(spark, d, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    commands = s.select(F.col("r_name").alias("app"), F.col("s_name").alias("command"), F.col("s_suppkey").alias("handler"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("family"))
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("callee"))
    i = star.table(spark, d, "lineitem").where("l_returnflag = 'R'").join(p, "l_partkey").where("p_brand <> 'Brand#1'")
    inits = star.table(spark, d, "customer").where("c_acctbal < -990").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("app"))
    return design.assembled_flow(commands, i.select(F.col("l_suppkey").alias("handler"), "callee", (F.col("l_discount") < 0.08).alias("resolved")), inits, [])
