"""Queries of methods in several steps: communities, invalidation, designs by origin, cycles, integrity, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import settled, shared_path
from graphloom.operators import accuracy, architecture, compare, graph, invalidation, relational, search, snapshots, trace
from graphloom.operators import communities as com
from graphloom.plans.compared import _FEATURES, _topology, _units
from graphloom.plans.registry import query
from graphloom.sources import star

# -- communities -----------------------------------------------------------------------------------


def _communities_sql(name: str, edges: str, rounds: int = 4, levels: int = 3) -> str:
    """Tables {name}_member (id, node) and {name}_final (id, community) of the edges (src, dst, weight) selected."""
    out = f""", {name}_arcs0 AS MATERIALIZED (SELECT src, dst, sum(w)::HUGEINT AS w FROM (SELECT src, dst, weight AS w FROM ({edges}) UNION ALL SELECT dst, src, weight FROM ({edges})) GROUP BY src, dst)
, {name}_total AS MATERIALIZED (SELECT sum(w)::HUGEINT AS t FROM {name}_arcs0), {name}_member0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS node FROM {name}_arcs0)"""
    for level in range(levels):
        arcs, lab = f"{name}_arcs{level}", f"{name}_lab{level}_0"
        out += f"\n, {lab} AS MATERIALIZED (SELECT src AS node, src AS c, sum(w)::HUGEINT AS k FROM {arcs} GROUP BY src)"
        for r in range(rounds):
            new = f"{name}_lab{level}_{r + 1}"
            out += f"""
, {new} AS MATERIALIZED (SELECT node, CASE WHEN c <> own AND md5(node || ':{level * rounds + r}') < '8' THEN c ELSE own END AS c, k FROM (
    SELECT x.node, x.c, o.c AS own, o.k, row_number() OVER (PARTITION BY x.node ORDER BY x.w * t - o.k * (s.all_k - CASE WHEN x.c = o.c THEN o.k ELSE 0 END) DESC, x.c <> o.c, x.c) AS rn
    FROM (SELECT node, c, sum(w)::HUGEINT AS w FROM (SELECT a.src AS node, b.c, a.w FROM {arcs} a JOIN {lab} b ON b.node = a.dst WHERE a.src <> a.dst UNION ALL SELECT node, c, 0 FROM {lab}) GROUP BY node, c) x
    JOIN {lab} o ON o.node = x.node JOIN (SELECT c, sum(k)::HUGEINT AS all_k FROM {lab} GROUP BY c) s ON s.c = x.c, {name}_total) WHERE rn = 1)"""
            lab = new
        out += f"""
, {name}_member{level + 1} AS MATERIALIZED (SELECT m.id, l.c AS node FROM {name}_member{level} m JOIN {lab} l ON l.node = m.node)
, {name}_arcs{level + 1} AS MATERIALIZED (SELECT x.c AS src, y.c AS dst, sum(w)::HUGEINT AS w FROM {arcs} a JOIN {lab} x ON x.node = a.src JOIN {lab} y ON y.node = a.dst GROUP BY ALL)"""
    return out + f"\n, {name}_final AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY node) AS community FROM {name}_member{levels})"


_SUPPLY = "SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL"


def _supply(spark, d) -> DataFrame:
    rows = star.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    return rows.select(star.node_id("supplier", "l_suppkey").alias("src"), star.node_id("part", "l_partkey").alias("dst"), "weight")


@query("h23_communities", f"WITH one AS (SELECT 1){_communities_sql('s', _SUPPLY)} SELECT * FROM s_final", graph=False)
def h23_communities(spark, d):
    """Suppliers and parts that are delivered together."""
    return com.communities(_supply(spark, d))


@query("h23_modularity", f"""WITH one AS (SELECT 1){_communities_sql('s', _SUPPLY)}
, k AS (SELECT a.community, sum(w)::DOUBLE AS k, sum(CASE WHEN a.community = b.community THEN w ELSE 0 END)::DOUBLE AS inside FROM s_arcs0 JOIN s_final a ON a.id = src JOIN s_final b ON b.id = dst GROUP BY ALL)
SELECT count(*) AS communities, round(sum(inside) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) AS modularity FROM k""", graph=False)
def h23_modularity(spark, d):
    edges = _supply(spark, d)
    return com.modularity(edges, settled(com.communities(edges), "communities"))


#: A hub of the analysis graph has so many edges in.
FAN_IN = 25

_SOFT = f"""
, hub AS (SELECT dst AS id FROM topo WHERE kind IN ('CALL', 'DATA', 'STATE') AND dst LIKE 'f:%' GROUP BY dst HAVING count(*) >= {FAN_IN})
, node_ AS (SELECT src AS id FROM topo UNION SELECT dst FROM topo WHERE dst LIKE 'f:%')
"""


def _soft_sql(units: str, name: str) -> str:
    """{name} (unit and soft features) of the members (unit, id) in a table."""
    side = lambda mine, other, c: f"""SELECT unit, round(count(DISTINCT {other}) / count(*), 3) AS {c} FROM (SELECT DISTINCT unit, id FROM {units}) m JOIN topo ON kind = 'CALL' AND {mine} = m.id
      WHERE (unit, {other}) NOT IN (SELECT unit, id FROM {units}) GROUP BY unit"""  # noqa: E731
    return f"""
, {name} AS MATERIALIZED (SELECT z.unit, z.size, round((coalesce(out_c, 0) + coalesce(in_c, 0)) / 2, 4) AS concentration, round(dominant / z.size, 3) AS declared_affinity, round(coalesce(shared, 0) / z.size, 3) AS resource_similarity,
    round(coalesce(hubs, 0) / z.size, 3) AS hub_contamination
  FROM (SELECT unit, count(DISTINCT id) AS size FROM {units} GROUP BY unit) z
  JOIN (SELECT unit, max(n) AS dominant FROM (SELECT unit, module, count(*) AS n FROM (SELECT DISTINCT unit, id FROM {units}) LEFT JOIN modu USING (id) GROUP BY ALL) GROUP BY unit) a USING (unit)
  LEFT JOIN (SELECT unit, max(n) AS shared FROM (SELECT unit, dst, count(DISTINCT id) AS n FROM {units} JOIN topo ON kind = 'RESOURCE' AND src = id GROUP BY ALL) GROUP BY unit) r USING (unit)
  LEFT JOIN (SELECT unit, count(DISTINCT id) AS hubs FROM {units} JOIN hub USING (id) GROUP BY unit) h USING (unit)
  LEFT JOIN ({side('src', 'dst', 'out_c')}) o USING (unit) LEFT JOIN ({side('dst', 'src', 'in_c')}) i USING (unit))"""


_SCORE = "round(0.4::DOUBLE * round((concentration - 0.5::DOUBLE) * 4, 3) + 0.3::DOUBLE * declared_affinity + (-1.5::DOUBLE * hub_contamination) + 0.2::DOUBLE * resource_similarity, 4)"


def _parts(spark, d) -> dict[str, DataFrame]:
    units, edges, modules = _units(spark, d)
    edges = settled(edges, "edges")
    own = edges.where("dst LIKE 'f:%'")
    suppressed = settled(com.hubs(own, FAN_IN), "hubs")
    nodes = edges.select(F.col("src").alias("id")).unionByName(own.select(F.col("dst").alias("id"))).distinct()
    return {"units": settled(units, "units"), "edges": edges, "modules": modules, "hubs": suppressed, "nodes": nodes}


@query("d16_soft_features", f"{_FEATURES}{_SOFT}{_soft_sql('un', 'soft')} SELECT *, {_SCORE} AS score FROM soft", graph=False)
def d16_soft_features(spark, d):
    """Interface, affinity, resources and hubs of the seeds' units, with the score they make."""
    p = _parts(spark, d)
    return com.soft_features(p["units"], p["edges"], p["modules"], p["hubs"]).withColumn("score", com.soft_score())


_MET = """
, {n}_met AS (SELECT unit, e, any_value(x.kind) AS kind, any_value(resolution) AS resolution, count(*) = 2 OR bool_or(x.src = x.dst) AS inside FROM {u} JOIN (SELECT *, unnest(list_distinct([src, dst])) AS node FROM edge) x ON x.node = id GROUP BY unit, e)
, {n}_why AS (SELECT z.unit, coalesce(st, 0) AS crossing_state, coalesce(un_, 0) AS uncertainty, coalesce(mo, 0) AS modules, array_to_string(list_filter([CASE WHEN coalesce(st, 0) >= 3 THEN 'R3_state_crossing_heavy' END, CASE WHEN coalesce(un_, 0) >= 5 THEN 'R6_uncertainty_high' END, CASE WHEN coalesce(mo, 0) > 2 THEN 'cross_declared_mixed' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT DISTINCT unit FROM {u}) z LEFT JOIN (SELECT unit, count_if(kind = 'STATE' AND NOT inside) AS st, count_if(CASE WHEN inside THEN resolution IN ('UNKNOWN', 'CANDIDATE_SET') ELSE resolution = 'UNKNOWN' END) AS un_ FROM {n}_met GROUP BY unit) USING (unit)
  LEFT JOIN (SELECT unit, count(DISTINCT module) AS mo FROM {u} JOIN modu USING (id) GROUP BY unit) USING (unit))"""

_ANALYSIS = "SELECT src, dst, sum(CASE kind WHEN 'CALL' THEN 2 WHEN 'DATA' THEN 4 WHEN 'STATE' THEN 5 ELSE 1 END) AS weight FROM topo WHERE src <> dst AND src IN (SELECT id FROM node_) AND dst IN (SELECT id FROM node_) AND src NOT IN (SELECT id FROM hub) AND dst NOT IN (SELECT id FROM hub) GROUP BY src, dst"


@query("d19_routes", f"""{_FEATURES}{_SOFT}
, fr AS MATERIALIZED (SELECT unit, id FROM un WHERE id NOT IN (SELECT id FROM hub) AND id IN (SELECT id FROM node_)){_soft_sql('fr', 'soft')}{_MET.format(n='s', u='fr')}
, s_cnt AS (SELECT unit, 1.0::DOUBLE * count_if(kind = 'DATA' AND inside) + 1.0::DOUBLE * count_if(kind = 'STATE' AND inside) + 0.5::DOUBLE * count_if(kind = 'CALL' AND inside)
    - (1.0::DOUBLE * count_if(kind = 'DATA' AND NOT inside) + 1.5::DOUBLE * count_if(kind = 'STATE' AND NOT inside) + 0.7::DOUBLE * count_if(kind = 'CALL' AND NOT inside) + 0.8::DOUBLE * count_if(kind = 'RESOURCE' AND NOT inside)) AS x FROM s_met GROUP BY unit)
{_communities_sql('c', _ANALYSIS)}, cu AS MATERIALIZED (SELECT 'community:' || community AS unit, id FROM c_final){_soft_sql('cu', 'softc')}{_MET.format(n='k', u='cu')}
, every AS (SELECT 'A' AS route, unit, round(x - 1.2::DOUBLE * uncertainty, 3) AS score, reasons FROM soft JOIN s_why USING (unit) JOIN s_cnt USING (unit) WHERE size >= 3
  UNION ALL SELECT 'B', unit, round({_SCORE} - 0.5::DOUBLE * uncertainty, 4), reasons FROM soft JOIN s_why USING (unit) WHERE size >= 3
  UNION ALL SELECT 'C', unit, {_SCORE}, reasons FROM softc JOIN k_why USING (unit) WHERE size >= 3)
SELECT route, unit, score, CASE WHEN reasons = '' THEN 'LEGAL' ELSE 'REJECTED' END AS legal, reasons, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, unit) AS rank FROM every) WHERE rank <= 40""", graph=False)
def d19_routes(spark, d):
    """The best units of three routes: seeds by hard and by soft features, communities by soft features, each with its legality."""
    p = _parts(spark, d)
    units = p["units"].select("unit", "id").distinct().join(p["hubs"], "id", "left_anti").join(p["nodes"], "id", "left_semi")
    units = settled(units, "units")
    graph_ = settled(com.analysis_graph(p["edges"], p["nodes"], p["hubs"]), "analysis")
    found = settled(com.communities(graph_).select(F.concat(F.lit("community:"), "community").alias("unit"), "id"), "communities")
    judged = lambda rows: com.soft_features(rows, p["edges"], p["modules"], p["hubs"]).join(compare.features(rows, p["edges"], p["modules"]).drop("size"), "unit").where("size >= 3")
    seeds = settled(judged(units), "seeds")
    reasons = compare.illegal(seeds)
    rows = seeds.select(F.lit("A").alias("route"), "unit", com.hard_score().alias("score"), reasons.alias("reasons"))
    rows = rows.unionByName(seeds.select(F.lit("B").alias("route"), "unit", com.soft_score(0.5 * F.col("uncertainty")).alias("score"), reasons.alias("reasons")))
    rows = rows.unionByName(judged(found).select(F.lit("C").alias("route"), "unit", com.soft_score().alias("score"), reasons.alias("reasons")))
    return com.best(rows, 40)


# -- invalidation ----------------------------------------------------------------------------------

#: What was shipped in this month is the change; what was shipped before it, the state before.
MONTH = ("1998-01-01", "1998-02-01")

_STALE = f"""
WITH RECURSIVE x AS (SELECT *, p_brand || '-' || p_size AS name, 'part:' || p_partkey AS file FROM lineitem JOIN part ON l_partkey = p_partkey)
, old AS (SELECT file, name, max(l_discount) AS meta FROM x WHERE l_shipdate < TIMESTAMP '{MONTH[0]}' GROUP BY ALL), new AS (SELECT file, name, max(l_discount) AS meta FROM x WHERE l_shipdate < TIMESTAMP '{MONTH[1]}' GROUP BY ALL)
, seed AS (SELECT DISTINCT x.file, o.meta IS DISTINCT FROM n.meta AS semantic FROM x LEFT JOIN old o ON o.file = x.file LEFT JOIN new n ON n.file = x.file WHERE l_shipdate >= TIMESTAMP '{MONTH[0]}' AND l_shipdate < TIMESTAMP '{MONTH[1]}')
, chg AS (SELECT DISTINCT name, file AS qname FROM ((SELECT * FROM old EXCEPT SELECT * FROM new) UNION (SELECT * FROM new EXCEPT SELECT * FROM old)) WHERE file IN (SELECT file FROM seed WHERE semantic))
, inc AS (SELECT DISTINCT file, nxt AS target FROM (SELECT file, p_name, lead(file) OVER w AS nxt, lead(p_name) OVER w AS other FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber)) WHERE p_name = other AND nxt <> file)
, clo(file) AS (SELECT file FROM seed WHERE semantic UNION SELECT i.file FROM clo c JOIN inc i ON i.target = c.file)
SELECT file, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM (
  SELECT file, 'source_or_context_delta' AS reason FROM seed
  UNION ALL SELECT i.file, 'includes:' || i.target FROM inc i WHERE i.target IN (SELECT file FROM clo) AND i.file NOT IN (SELECT file FROM seed WHERE semantic)
  UNION ALL SELECT 'order:' || l_orderkey, 'symbol:' || name FROM x WHERE name IN (SELECT name FROM chg)
  UNION ALL SELECT 'customer:' || o_custkey, 'symbolic_edge' FROM orders JOIN x ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND (file IN (SELECT qname FROM chg) OR name IN (SELECT name FROM chg))
  UNION ALL SELECT 'supplier:' || l_suppkey, 'imports:' || file FROM x WHERE l_returnflag = 'R' AND file IN (SELECT qname FROM chg)) GROUP BY file
"""


@query("h18_reasons", _STALE, graph=False)
def h18_reasons(spark, d):
    """Parts are files that define themselves; parts of one name that follow in an order include each other; orders
    call parts by name, urgent open orders leave edges of customers pending, suppliers import what came back."""
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("name"))
    x = star.table(spark, d, "lineitem").join(p, "l_partkey").withColumn("file", star.node_id("part", "l_partkey"))
    low, high = (F.lit(day).cast("timestamp_ntz") for day in MONTH)
    defs = lambda day: x.where(F.col("l_shipdate") < day).groupBy("file", "name").agg(F.max("l_discount").alias("meta")).withColumn("qname", F.col("file"))
    old, new = settled(defs(low), "old"), settled(defs(high), "new")
    side = lambda rows, n: rows.select("file", F.col("meta").alias(n))
    seeds = x.where((F.col("l_shipdate") >= low) & (F.col("l_shipdate") < high)).select("file").distinct().join(side(old, "a"), "file", "left").join(side(new, "b"), "file", "left")
    seeds = settled(seeds.select("file", (~F.col("a").eqNullSafe(F.col("b"))).alias("semantic")), "seeds")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber")
    follow = x.select("file", "p_name", F.lead("file").over(w).alias("target"), F.lead("p_name").over(w).alias("other"))
    includes = follow.where("p_name = other AND target <> file").select("file", "target").distinct()
    calls = x.select(star.node_id("order", "l_orderkey").alias("file"), F.col("name").alias("callee"), F.array("file").alias("candidates"))
    urgent = star.table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pending = x.join(urgent, "l_orderkey").select(star.node_id("customer", "o_custkey").alias("owner"), "file", "name").select(F.col("owner").alias("file"), F.col("file").alias("src"), F.col("name").alias("dst"))
    imports = x.where("l_returnflag = 'R'").select(F.col("file").alias("module"), star.node_id("supplier", "l_suppkey").alias("file"))
    return invalidation.invalidated(seeds, old, new, includes, calls, pending, imports)


# -- designs by origin -----------------------------------------------------------------------------

_ORIGINS = """
WITH RECURSIVE x AS (SELECT *, year(l_shipdate) AS y, 'part:' || l_partkey || '@' || year(l_shipdate) AS id, CASE WHEN s_acctbal >= 0 THEN 'supplier:' || l_suppkey ELSE 'group:' || l_suppkey END AS owner FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
, v AS (SELECT l_partkey, y, id, arg_max(l_returnflag, (l_quantity, l_orderkey, l_linenumber)) AS kind, arg_max(l_linestatus, (l_quantity, l_orderkey, l_linenumber)) AS status, arg_max(owner, (l_quantity, l_orderkey, l_linenumber)) AS parent FROM x GROUP BY ALL)
, ver AS (SELECT *, lag(id) OVER (PARTITION BY l_partkey ORDER BY y) AS origin_id FROM v)
, root(id, origin) AS (SELECT id, id FROM ver WHERE origin_id IS NULL UNION ALL SELECT ver.id, origin FROM root JOIN ver ON ver.origin_id = root.id)
, sup AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal >= 0), grp AS (SELECT 'group:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0)
, base AS (SELECT id, kind, status, parent FROM ver WHERE y = 1995 UNION ALL SELECT id, 'SUPPLIER', '', NULL FROM sup)
, work AS (SELECT w.id, CASE WHEN origin IN (SELECT id FROM base) THEN origin END AS origin, kind, status, parent FROM (SELECT ver.id, kind, status, parent, origin FROM ver JOIN root USING (id) WHERE y = 2000 UNION ALL SELECT id, 'SUPPLIER', '', NULL, id FROM sup UNION ALL SELECT id, 'SUPPLIER', '', NULL, NULL FROM grp) w)
, fst AS (SELECT * FROM work WHERE origin IS NOT NULL)
, rb AS (SELECT DISTINCT l_returnflag AS kind, id AS src, owner AS dst FROM x WHERE y = 1995 AND s_acctbal >= 0), rw AS (SELECT DISTINCT l_returnflag AS kind, x.id AS src, owner AS dst, a.origin AS so, b.origin AS d_ FROM x JOIN work a ON a.id = x.id JOIN work b ON b.id = owner WHERE y = 2000)
, mp AS (SELECT id, list_sort(list(DISTINCT 'tax:' || (100 * l_tax)::INTEGER)) AS m FROM x GROUP BY id)
, mc AS (SELECT f.id, array_to_string(list_sort(list_filter(coalesce(b.m, []), lambda e: NOT list_contains(coalesce(w.m, []), e))), ',') AS gone, array_to_string(list_sort(list_filter(coalesce(w.m, []), lambda e: NOT list_contains(coalesce(b.m, []), e))), ',') AS come
  FROM fst f LEFT JOIN mp w ON w.id = f.id LEFT JOIN mp b ON b.id = f.origin)
SELECT 'component_added' AS change, id AS subject, NULL AS old, NULL AS new FROM work WHERE origin IS NULL
UNION ALL SELECT 'component_removed', id, NULL, NULL FROM base WHERE id NOT IN (SELECT origin FROM fst)
UNION ALL SELECT 'component_modified', f.id, NULL, array_to_string(list_filter([CASE WHEN f.kind <> b.kind THEN 'kind' END, CASE WHEN f.status <> b.status THEN 'status' END], lambda e: e IS NOT NULL), ',') FROM fst f JOIN base b ON b.id = f.origin WHERE f.kind <> b.kind OR f.status <> b.status
UNION ALL SELECT 'component_moved', f.id, b.parent, f.parent FROM fst f JOIN base b ON b.id = f.origin LEFT JOIN work p ON p.id = f.parent WHERE CASE WHEN f.parent IS NULL THEN b.parent IS NOT NULL ELSE coalesce(p.origin <> b.parent, true) END
UNION ALL SELECT 'relation_added', kind || '|' || src || '|' || dst, NULL, NULL FROM rw WHERE so IS NULL OR d_ IS NULL OR (kind, so, d_) NOT IN (SELECT kind, src, dst FROM rb)
UNION ALL SELECT 'relation_removed', kind || '|' || src || '|' || dst, NULL, NULL FROM rb WHERE (kind, src, dst) NOT IN (SELECT kind, so, d_ FROM rw WHERE so IS NOT NULL AND d_ IS NOT NULL)
UNION ALL SELECT 'mapping_changed', id, gone, come FROM mc WHERE gone <> '' OR come <> ''
"""


@query("g5_architecture_diff", _ORIGINS, graph=False)
def g5_architecture_diff(spark, d):
    """A part's deliveries of a year are a component that was forked from those of the last year with any; the design
    of 2000 against that of 1995. Suppliers are groups; those in debt are new ones."""
    s = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    owner = F.concat(F.when(F.col("s_acctbal") >= 0, "supplier:").otherwise("group:"), F.col("l_suppkey").cast("string"))
    version = lambda y: F.concat(F.lit("part:"), F.col("l_partkey").cast("string"), F.lit("@"), y.cast("string"))
    x = star.table(spark, d, "lineitem").join(s, "l_suppkey").withColumns({"y": F.year("l_shipdate"), "owner": owner})
    most = lambda c, name: F.max_by(c, F.struct("l_quantity", "l_orderkey", "l_linenumber")).alias(name)
    entity = F.array_sort(F.collect_set(F.concat(F.lit("tax:"), F.round(100 * F.col("l_tax")).cast("int").cast("string")))).alias("entities")
    v = x.groupBy("l_partkey", "y").agg(most("l_returnflag", "kind"), most("l_linestatus", "status"), most("owner", "parent"), entity)
    w = Window.partitionBy("l_partkey").orderBy("y")
    ver = settled(v.withColumns({"id": version(F.col("y")), "origin_id": version(F.lag("y").over(w))}), "versions")
    ends = architecture.origins(ver.select("id", "origin_id"))
    ver = settled(ver.join(ends, "id").withColumn("origin", F.coalesce("origin", "id")), "rooted")
    groups = s.select(F.concat(F.when(F.col("s_acctbal") >= 0, "supplier:").otherwise("group:"), F.col("l_suppkey").cast("string")).alias("id"), F.lit("SUPPLIER").alias("kind"), F.lit("").alias("status"), F.lit(None).cast("string").alias("parent"))
    known = groups.where(F.col("id").startswith("supplier:"))
    cols = ["id", "parent", "kind", "status"]
    base, work = ver.where("y = 1995").select(*cols), ver.where("y = 2000").select("origin", *cols)
    relations = lambda y: x.where(F.col("y") == y).select(F.col("l_returnflag").alias("kind"), version(F.col("y")).alias("src"), F.col("owner").alias("dst")).distinct()
    maps = lambda y: ver.where(F.col("y") == y).select("id", F.explode("entities").alias("entity"))
    before = {"components": base.unionByName(known.select(*cols)), "relations": relations(1995).where("dst LIKE 'supplier:%'"), "mappings": maps(1995)}
    work = work.unionByName(groups.withColumn("origin", F.when(F.col("id").startswith("supplier:"), F.col("id"))).select("origin", *cols))
    return architecture.changes(before, {"components": work, "relations": relations(2000), "mappings": maps(2000)}, ["kind", "status"])


# -- long cycles -----------------------------------------------------------------------------------

_RETURNS = """
WITH RECURSIVE ret AS (SELECT 'part:' || l_partkey AS src, 'part:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F')
, arc AS (SELECT DISTINCT src, dst FROM ret WHERE dst IS NOT NULL AND src <> dst)
, live0 AS MATERIALIZED (SELECT * FROM arc WHERE src IN (SELECT dst FROM arc) AND dst IN (SELECT src FROM arc)), live1 AS MATERIALIZED (SELECT * FROM live0 WHERE src IN (SELECT dst FROM live0) AND dst IN (SELECT src FROM live0))
, live AS MATERIALIZED (SELECT * FROM live1 WHERE src IN (SELECT dst FROM live1) AND dst IN (SELECT src FROM live1))
, w(root, e, path) AS (SELECT src, dst, [src, dst] FROM live WHERE dst > src UNION ALL SELECT w.root, l.dst, list_append(w.path, l.dst) FROM w JOIN live l ON l.src = w.e WHERE len(w.path) < 12 AND l.dst > w.root AND NOT list_contains(w.path, l.dst))
, cyc AS (SELECT array_to_string(path, '>') AS path, len(path)::BIGINT AS nodes FROM w WHERE (e, root) IN (SELECT src, dst FROM live))"""


def _returns(spark, d) -> DataFrame:
    """Parts that follow one another among an order's returned lines, of finished orders."""
    done = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = star.table(spark, d, "lineitem").where("l_returnflag = 'R'").join(done, "l_orderkey", "left_semi")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber")
    pairs = rows.select("l_partkey", F.lead("l_partkey").over(w).alias("next")).where("next IS NOT NULL AND next <> l_partkey").distinct()
    return pairs.select(star.node_id("part", "l_partkey").alias("src"), star.node_id("part", "next").alias("dst"))


@query("h15_long_cycles", f"{_RETURNS} SELECT * FROM cyc", graph=False)
def h15_long_cycles(spark, d):
    return graph.long_cycles(_returns(spark, d), 12)


@query("k12_long_cycles", f"{_RETURNS} SELECT 'C002' AS rule, 'WARNING' AS severity, 'VIOLATION' AS status, path AS subject, nodes FROM cyc WHERE nodes > 2", graph=False)
def k12_long_cycles(spark, d):
    """Rule C002 over cycles of up to twelve nodes; two parts that return together are no finding."""
    found = graph.long_cycles(_returns(spark, d), 12).where("nodes > 2")
    return found.select(F.lit("C002").alias("rule"), F.lit("WARNING").alias("severity"), F.lit("VIOLATION").alias("status"), F.col("path").alias("subject"), "nodes")


# -- traces and accuracy ---------------------------------------------------------------------------

_TRACES = """
WITH e AS (SELECT user_id || '/' || ts::DATE AS run, ts, event_id, value, event_type, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS step, left(json_extract_string(props, '$.k'), 1) AS site FROM events WHERE event_type <> 'signup')
, known AS (SELECT left(json_extract_string(props, '$.k'), 1) AS site FROM events WHERE event_type = 'signup' GROUP BY site HAVING count(*) * 12 > (SELECT count(*) FROM events WHERE event_type = 'signup'))
, mark AS (SELECT run, count_if(step > 0 AND value >= 1) AS enters, count_if(step < 0 AND value >= 1) AS exits, count_if(value > 60) AS failed FROM e GROUP BY run HAVING arg_max(event_type, (ts, event_id)) <> 'view')
, s AS (SELECT *, sum(step) OVER (PARTITION BY run ORDER BY ts, event_id) AS s FROM e)
, m AS (SELECT *, least(0, min(s) OVER w) AS low, coalesce(least(0, min(s) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS before FROM s WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
, f AS (SELECT *, step < 0 AND s < before AS empty, CASE WHEN step > 0 THEN s - low WHEN s >= before THEN s - low + 1 END AS level FROM m)
, p AS (SELECT *, CASE WHEN level IS NOT NULL THEN lag(site) OVER (PARTITION BY run, level ORDER BY ts, event_id) END AS opened FROM f)
, r AS (SELECT run, count_if(step > 0) AS enters, count_if(step < 0) AS exits, count_if(empty) AS empty, count_if(step < 0 AND NOT empty AND opened IS DISTINCT FROM site) AS wrong, bool_or(site NOT IN (SELECT site FROM known)) AS unmapped FROM p GROUP BY run)
, x AS (SELECT r.*, array_to_string(list_filter([CASE WHEN k.run IS NULL THEN 'end_marker_malformed,end_marker_missing' END, CASE WHEN r.enters <> r.exits THEN 'enter_exit_count_mismatch' END, CASE WHEN k.enters <> r.enters OR k.exits <> r.exits THEN 'event_count_mismatch' END,
    CASE WHEN wrong > 0 OR empty > 0 THEN 'exit_stack_mismatch' END, CASE WHEN failed > 0 THEN 'trace_write_failure' END, CASE WHEN r.enters > r.exits - empty THEN 'unclosed_frames' END, CASE WHEN unmapped THEN 'unmapped_function_offset' END], lambda c: c IS NOT NULL), ',') AS errors FROM r LEFT JOIN mark k ON k.run = r.run)
SELECT run, CASE WHEN errors = '' THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, errors, enters, exits FROM x"""


@query("e5_trace_errors", _TRACES, graph=False)
def e5_trace_errors(spark, d):
    """Views and clicks of a user and day enter, purchases and errors exit; sign-ups tell the known sites; runs that
    end in a view have no END, and END does not count events of small value."""
    site = F.substring(F.get_json_object("props", "$.k"), 1, 1).alias("site")
    e = star.table(spark, d, "events")
    step = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1).cast("long")
    run = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run")
    rows = e.where("event_type <> 'signup'").select(run, "ts", "event_id", "value", "event_type", step.alias("step"), site)
    told = e.where("event_type = 'signup'").groupBy(site).agg(F.count("*").alias("n"))
    known = told.join(told.agg(F.sum("n").alias("all")), F.col("n") * 12 > F.col("all")).select("site")
    big = F.col("value") >= 1
    mark = rows.groupBy("run").agg(F.count_if((F.col("step") > 0) & big).alias("enters"), F.count_if((F.col("step") < 0) & big).alias("exits"), F.count_if(F.col("value") > 60).alias("failed"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return trace.trace_errors(rows.drop("value", "event_type"), ["run"], ["ts", "event_id"], known, mark.where("last <> 'view'").drop("last"))


_PAIRS = """
WITH x AS (SELECT l_returnflag AS kind, p_brand AS src, s_nationkey::VARCHAR AS dst, p_type AS src_path, l_linestatus AS dst_path, dayofyear(l_shipdate)::BIGINT AS line, l_orderkey, l_linenumber, year(l_shipdate) AS y FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
, e AS (SELECT *, row_number() OVER (PARTITION BY kind, src, dst, src_path, dst_path ORDER BY line, l_orderkey, l_linenumber) AS n FROM x WHERE y = 1996), a AS (SELECT *, row_number() OVER (PARTITION BY kind, src, dst, src_path, dst_path ORDER BY line, l_orderkey, l_linenumber) AS n FROM x WHERE y = 1997)
, j AS (SELECT kind, src, dst, src_path, dst_path, e.line AS el, e.l_orderkey AS eo, e.l_linenumber AS en, a.line AS al, a.l_orderkey AS ao, a.l_linenumber AS an FROM e FULL JOIN a USING (kind, src, dst, src_path, dst_path, n))
, re AS (SELECT kind, src, dst, row_number() OVER (PARTITION BY kind, src, dst ORDER BY src_path, dst_path, el, eo, en) AS n FROM j WHERE al IS NULL), ra AS (SELECT kind, src, dst, row_number() OVER (PARTITION BY kind, src, dst ORDER BY src_path, dst_path, al, ao, an) AS n FROM j WHERE el IS NULL)
, m AS (SELECT kind, 'exact' AS match, abs(el - al) <= 1 AS near FROM j WHERE el IS NOT NULL AND al IS NOT NULL
  UNION ALL SELECT coalesce(re.kind, ra.kind), CASE WHEN ra.kind IS NULL THEN 'missed' WHEN re.kind IS NULL THEN 'extra' ELSE 'loose' END, false FROM re FULL JOIN ra ON re.kind = ra.kind AND re.src = ra.src AND re.dst = ra.dst AND re.n = ra.n)
, c AS (SELECT kind, count_if(match = 'exact')::BIGINT AS exact, count_if(match = 'loose')::BIGINT AS loose, count_if(match = 'missed')::BIGINT AS missed, count_if(match = 'extra')::BIGINT AS extra, count_if(near)::BIGINT AS near FROM m GROUP BY kind)
SELECT kind, exact, loose, missed, extra, round((exact + loose) / (exact + loose + extra), 6) AS precision, round((exact + loose) / (exact + loose + missed), 6) AS recall, round(near / exact, 6) AS location_accuracy FROM c"""


@query("d38_two_step_accuracy", _PAIRS, graph=False)
def d38_two_step_accuracy(spark, d):
    """What was shipped in 1997 against 1996: brand to nation by what came of it, with type and state as paths and the day as the line."""
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("src"), F.col("p_type").alias("src_path"))
    s = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("dst"))
    x = star.table(spark, d, "lineitem").join(p, "l_partkey").join(s, "l_suppkey")
    x = x.select(F.col("l_returnflag").alias("kind"), "src", "dst", "src_path", F.col("l_linestatus").alias("dst_path"), F.dayofyear("l_shipdate").cast("long").alias("line"), "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"))
    pairs = accuracy.matched(x.where("y = 1996"), x.where("y = 1997"), ["kind", "src", "dst", "src_path", "dst_path"], ["kind", "src", "dst"], "line", ["l_orderkey", "l_linenumber"])
    return accuracy.figures(pairs, ["kind"])


# -- chains of data --------------------------------------------------------------------------------


@query("h14_part_chains", """
WITH RECURSIVE x AS (SELECT 'part:' || l_partkey AS src, 'part:' || lead(l_partkey) OVER w AS dst, l_returnflag AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) QUALIFY o_orderstatus = 'F' AND lead(l_partkey) OVER w IS NOT NULL)
, d AS MATERIALIZED (SELECT DISTINCT src, dst FROM x WHERE f = 'A' AND src <> dst), w(path, e) AS (SELECT [src, dst], dst FROM d UNION ALL SELECT list_append(path, dst), dst FROM w JOIN d ON src = e WHERE len(path) < 5 AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path, len(path)::BIGINT AS nodes FROM w WHERE e NOT IN (SELECT src FROM d)""", graph=False)
def h14_part_chains(spark, d):
    """Parts that follow one another in finished orders, the first of them accepted: chains of at most five up to a part that nothing follows."""
    done = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber")
    x = star.table(spark, d, "lineitem").join(done, "l_orderkey", "left_semi").withColumn("next", F.lead("l_partkey").over(w)).where("next IS NOT NULL AND next <> l_partkey AND l_returnflag = 'A'")
    arcs = settled(x.select(star.node_id("part", "l_partkey").alias("src"), star.node_id("part", "next").alias("dst")).distinct(), "data")
    return graph.simple_chains(arcs, arcs.select(F.col("src").alias("id")).distinct(), 5)


# -- snapshots and search --------------------------------------------------------------------------


@query("a6_snapshot_copy", """
, old AS (SELECT id, kind, name FROM nodes), gone AS (SELECT 'order:' || o_orderkey AS key FROM orders WHERE o_orderstatus = 'P'), fresh AS (SELECT 'order:' || o_orderkey AS id, 'ORDER' AS kind, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000)
, new AS (SELECT * FROM old WHERE id NOT IN (SELECT key FROM gone) UNION ALL SELECT * FROM fresh), kept AS (SELECT kind, src, dst FROM edges WHERE src NOT IN (SELECT key FROM gone))
SELECT 'nodes' AS "table", 'first' AS snapshot, kind, count(*) AS n, count(DISTINCT name) AS names FROM old GROUP BY kind UNION ALL SELECT 'nodes', 'second', kind, count(*), count(DISTINCT name) FROM new GROUP BY kind
UNION ALL SELECT 'edges', 'first', kind, count(*), count(DISTINCT src) FROM edges GROUP BY kind UNION ALL SELECT 'edges', 'second', kind, count(*), count(DISTINCT src) FROM kept GROUP BY kind""")
def a6_snapshot_copy(spark, d):
    """Nodes and edges as a first snapshot; a second is copied from it, with the pending orders left out or made anew."""
    root = shared_path(spark, "snapshots")
    snapshots.put({"nodes": star.nodes(spark, d).select("id", "kind", "name"), "edges": star.edges(spark, d).select("kind", "src", "dst")}, root, "first")
    pending = star.table(spark, d, "orders").where("o_orderstatus = 'P'")
    fresh = pending.where("o_totalprice > 100000").select(star.node_id("order", "o_orderkey").alias("id"), F.lit("ORDER").alias("kind"), F.col("o_orderpriority").alias("name"))
    gone = pending.select(star.node_id("order", "o_orderkey").alias("key"))
    snapshots.copy(spark, root, "first", "second", {"nodes": fresh}, gone, {"nodes": F.col("id"), "edges": F.col("src")})
    out = None
    for name, what in (("nodes", "name"), ("edges", "src")):
        for snapshot in ("first", "second"):
            rows = snapshots.read(spark, root, name, snapshot).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(what).alias("names"))
            rows = rows.select(F.lit(name).alias("table"), F.lit(snapshot).alias("snapshot"), "kind", "n", "names")
            out = rows if out is None else out.unionByName(rows)
    return out


_QNAMES = ", qn AS (SELECT id, name, path, lower(kind) || '.' || name AS qname FROM nodes)"


def _named(spark, d) -> DataFrame:
    return star.nodes(spark, d).withColumn("qname", F.concat_ws(".", F.lower("kind"), "name"))


def _spaced(c: str) -> str:
    return f"' ' || array_to_string(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' '"


@query("j1_tiered_search", f"""{_QNAMES}
, t AS (SELECT id, CASE WHEN qname = 'part.red ring' THEN 0 WHEN name = 'part.red ring' THEN 1 WHEN path = 'part.red ring' THEN 2 WHEN contains({_spaced('qname')}, ' part red ring ') OR contains({_spaced('name')}, ' part red ring ') OR contains({_spaced('path')}, ' part red ring ') THEN 3
  WHEN contains(lower(qname), 'part.red ring') OR contains(lower(name), 'part.red ring') OR contains(lower(path), 'part.red ring') THEN 4 END AS tier FROM qn
  UNION ALL SELECT id, CASE WHEN qname = 'economy' THEN 0 WHEN name = 'economy' THEN 1 WHEN path = 'economy' THEN 2 WHEN contains({_spaced('qname')}, ' economy ') OR contains({_spaced('name')}, ' economy ') OR contains({_spaced('path')}, ' economy ') THEN 3
  WHEN contains(lower(qname), 'economy') OR contains(lower(name), 'economy') OR contains(lower(path), 'economy') THEN 4 END FROM qn WHERE id NOT LIKE 'part:%7'
  UNION ALL SELECT id, CASE WHEN contains({_spaced('name')}, ' 00000001 ') OR contains({_spaced('qname')}, ' 00000001 ') OR contains({_spaced('path')}, ' 00000001 ') THEN 3 WHEN contains(name, '00000001') OR contains(qname, '00000001') OR contains(path, '00000001') THEN 4 END FROM qn)
SELECT id, ['exact:qname', 'exact:name', 'exact:path', 'fts', 'like'][tier + 1] AS match, tier::INTEGER AS tier FROM t WHERE tier IS NOT NULL""")
def j1_tiered_search(spark, d):
    """Three searches in one table: a qualified name, a word of paths (but for some parts), a piece of a number."""
    n = _named(spark, d)
    every = 1 << 30
    rows = search.tiered(n, "part.red ring", every).unionByName(search.tiered(n.where("id NOT LIKE 'part:%7'"), "economy", every))
    return rows.unionByName(search.tiered(n, "00000001", every))


@query("j2_phrases", f"""{_QNAMES}
, w AS (SELECT id, c, list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM (SELECT id, unnest(['name', 'qname', 'path']) AS c, unnest([name, qname, path]) AS t FROM qn))
, p AS (SELECT id, c AS field, unnest(range(1, len(ws))) AS i, ws FROM w WHERE len(ws) > 1), ph AS (SELECT id, field, i - 1 AS pos FROM p WHERE ws[i] = 'small' AND ws[i + 1] = 'brand')
, al AS (SELECT id FROM w GROUP BY id HAVING bool_or(list_contains(ws, 'small')) AND bool_or(list_contains(ws, 'brand')))
SELECT al.id, coalesce(string_agg(field || '@' || pos, ',' ORDER BY field, pos), '') AS phrase_at FROM al LEFT JOIN ph USING (id) GROUP BY al.id""")
def j2_phrases(spark, d):
    """The nodes that hold both words, and where these stand as a phrase: of many of them nowhere."""
    index = search.positions(_named(spark, d))
    at = search.phrase(index, "small brand").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "pos"))), lambda x: F.concat_ws("@", x["field"], x["pos"].cast("string"))), ",").alias("phrase_at"))
    return search.all_words(index, "small brand").join(at, "id", "left").select("id", F.coalesce("phrase_at", F.lit("")).alias("phrase_at"))


@query("d14_ranked_candidates", f"""{_FEATURES}
, dec AS (SELECT unit, count(DISTINCT coalesce(module, '(none)')) AS declared FROM un LEFT JOIN modu USING (id) GROUP BY unit)
, outs AS (SELECT unit, count(DISTINCT data) AS data_out FROM un JOIN topo ON kind = 'DATA' AND src = un.id WHERE (unit, dst) NOT IN (SELECT unit, id FROM un) GROUP BY unit)
, sc AS (SELECT *, round(1.0::DOUBLE * internal_data + 1.0::DOUBLE * internal_state + 0.5::DOUBLE * internal_call - (1.0::DOUBLE * crossing_data + 1.5::DOUBLE * crossing_state + 0.7::DOUBLE * crossing_call + 0.8::DOUBLE * crossing_resource) - 1.2::DOUBLE * uncertainty, 3) AS score FROM why JOIN dec USING (unit) LEFT JOIN outs USING (unit))
, c AS (SELECT unit, score, n, reasons, 'FLOW' AS kind, 'flow' AS name, 0.75 - 0.05 * n AS confidence FROM sc WHERE seed = 'chain' AND size >= 2
  UNION ALL SELECT unit, score, n, reasons, 'MODULE', 'module', CASE WHEN crossing_state > 2 THEN least(0.6 - 0.05 * n, 0.35) ELSE 0.6 - 0.05 * n END FROM sc WHERE seed = 'state' AND size >= 2
  UNION ALL SELECT unit, score, n, reasons, 'MODULE', 'callreg', 0.55 - 0.04 * n FROM sc WHERE seed = 'call' AND size >= 3
  UNION ALL SELECT unit, score, n, reasons, 'COMPOSITE', 'composite', least(0.7::DOUBLE - 0.05::DOUBLE * n, CASE WHEN score > 0 THEN score / 8 ELSE 0.3 END) FROM sc WHERE seed = 'chain' AND size >= 3 AND declared = 1 AND coalesce(data_out, 0) <= 3)
SELECT 'candidate-' || name || '-' || row_number() OVER (ORDER BY n, score DESC, unit, name) AS candidate, unit, kind, round(confidence, 3)::DOUBLE AS confidence, reasons FROM c""", graph=False)
def d14_ranked_candidates(spark, d):
    """Candidates of four seeds: chains as flows and, where narrow and of one module, as composites; state; call regions."""
    units, edges, modules = _units(spark, d)
    units, edges = settled(units, "units"), settled(edges, "edges")
    m = units.select("unit", "id").distinct()
    declared = m.join(modules, "id", "left").groupBy("unit").agg(F.count_distinct(F.coalesce("module", F.lit("(none)"))).alias("declared"))
    # the data of an edge is the last part of its id
    leaving = m.withColumnRenamed("id", "src").join(edges.where("kind = 'DATA'").select("src", "dst", F.substring_index("id", "|", -1).alias("data")), "src")
    leaving = leaving.join(m.withColumnRenamed("id", "dst"), ["unit", "dst"], "left_anti").groupBy("unit").agg(F.count_distinct("data").alias("data_out"))
    f = compare.features(units, edges, modules).join(units.select("seed", "unit").distinct(), "unit").join(declared, "unit").join(leaving, "unit", "left").na.fill(0, ["data_out"])
    return compare.ranked_candidates(f.withColumn("score", com.hard_score()))


# -- candidates from seeds that the graph itself makes ---------------------------------------------

_PARTS = """
WITH RECURSIVE x AS (SELECT 'part:' || l_partkey AS src, 'part:' || lead(l_partkey) OVER w AS dst, l_returnflag AS f, p_name, lead(p_name) OVER w AS name2, p_size::VARCHAR AS size FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) QUALIFY o_orderstatus = 'F' AND lead(l_partkey) OVER w IS NOT NULL AND lead(l_partkey) OVER w <> l_partkey)
, topo AS MATERIALIZED (SELECT DISTINCT 'CALL' AS kind, src, dst, NULL AS data FROM x WHERE f = 'R' UNION ALL SELECT DISTINCT 'DATA', src, dst, size FROM x WHERE f = 'A' UNION ALL SELECT DISTINCT 'STATE', src, dst, p_name FROM x WHERE f = 'N' AND p_name = name2)
, modu AS (SELECT 'part:' || p_partkey AS id, p_type AS module FROM part)
, glue AS (SELECT 'call' AS seed, src, dst FROM topo JOIN modu a ON a.id = src JOIN modu b ON b.id = dst WHERE kind = 'CALL' AND a.module = b.module UNION SELECT 'state', src, dst FROM topo WHERE kind = 'STATE')
, arc AS MATERIALIZED (SELECT seed, src, dst FROM glue UNION SELECT seed, dst, src FROM glue)
, reach(seed, a, b) AS (SELECT DISTINCT seed, src, src FROM arc UNION SELECT r.seed, r.a, t.dst FROM reach r JOIN arc t ON t.seed = r.seed AND t.src = r.b)
, comp AS (SELECT seed, a AS id, seed || ':' || min(b) AS unit FROM reach GROUP BY seed, a)
, d AS MATERIALIZED (SELECT DISTINCT src, dst FROM topo WHERE kind = 'DATA'), walk(path, e) AS (SELECT [src, dst], dst FROM d UNION ALL SELECT list_append(path, dst), dst FROM walk JOIN d ON src = e WHERE len(path) < 5 AND NOT list_contains(path, dst))
, chain AS (SELECT 'chain:' || array_to_string(path, '>') AS unit, path FROM walk WHERE e NOT IN (SELECT src FROM d))
, unit_ AS MATERIALIZED (SELECT seed, unit, id FROM comp UNION ALL SELECT 'chain', unit, unnest(path) FROM chain)
, edge AS MATERIALIZED (SELECT kind, src, dst, row_number() OVER () AS e, CASE WHEN kind = 'STATE' THEN 'CANDIDATE_SET' ELSE 'EXACT' END AS resolution FROM topo)
, met AS MATERIALIZED (SELECT unit, e, any_value(x.kind) AS kind, any_value(resolution) AS resolution, count(*) = 2 AS inside FROM unit_ JOIN (SELECT *, unnest([src, dst]) AS node FROM edge) x ON x.node = id GROUP BY unit, e)
, cnt AS (SELECT unit, count_if(kind = 'CALL' AND inside) AS ic, count_if(kind = 'DATA' AND inside) AS id_, count_if(kind = 'STATE' AND inside) AS is_, count_if(kind = 'CALL' AND NOT inside) AS cc, count_if(kind = 'DATA' AND NOT inside) AS cd, count_if(kind = 'STATE' AND NOT inside) AS cs,
    count_if(inside AND resolution = 'CANDIDATE_SET') AS uncertainty FROM met GROUP BY unit)
, dec AS (SELECT unit, any_value(seed) AS seed, count(*) AS size, count(DISTINCT module) AS modules FROM unit_ JOIN modu USING (id) GROUP BY unit)
, outs AS (SELECT u.unit, count(DISTINCT data) AS data_out FROM unit_ u JOIN topo ON kind = 'DATA' AND src = u.id LEFT JOIN unit_ v ON v.unit = u.unit AND v.id = dst WHERE v.id IS NULL GROUP BY u.unit)
, sc AS (SELECT *, (cs >= 3)::INTEGER + (uncertainty >= 5)::INTEGER + (modules > 2)::INTEGER AS n, array_to_string(list_filter([CASE WHEN cs >= 3 THEN 'R3_state_crossing_heavy' END, CASE WHEN uncertainty >= 5 THEN 'R6_uncertainty_high' END, CASE WHEN modules > 2 THEN 'cross_declared_mixed' END], lambda r: r IS NOT NULL), ',') AS reasons,
    round(1.0::DOUBLE * id_ + 1.0::DOUBLE * is_ + 0.5::DOUBLE * ic - (1.0::DOUBLE * cd + 1.5::DOUBLE * cs + 0.7::DOUBLE * cc) - 1.2::DOUBLE * uncertainty, 3) AS score FROM dec JOIN cnt USING (unit) LEFT JOIN outs USING (unit))
, c AS (SELECT unit, score, n, reasons, 'FLOW' AS kind, 'flow' AS name, 0.75 - 0.05 * n AS confidence FROM sc WHERE seed = 'chain' AND size >= 2
  UNION ALL SELECT unit, score, n, reasons, 'MODULE', 'module', CASE WHEN cs > 2 THEN least(0.6 - 0.05 * n, 0.35) ELSE 0.6 - 0.05 * n END FROM sc WHERE seed = 'state' AND size >= 2
  UNION ALL SELECT unit, score, n, reasons, 'MODULE', 'callreg', 0.55 - 0.04 * n FROM sc WHERE seed = 'call' AND size >= 3
  UNION ALL SELECT unit, score, n, reasons, 'COMPOSITE', 'composite', least(0.7::DOUBLE - 0.05::DOUBLE * n, CASE WHEN score > 0 THEN score / 8 ELSE 0.3 END) FROM sc WHERE seed = 'chain' AND size >= 3 AND modules = 1 AND coalesce(data_out, 0) <= 3)
SELECT 'candidate-' || name || '-' || row_number() OVER (ORDER BY n, score DESC, unit, name) AS candidate, unit, kind, round(confidence, 3)::DOUBLE AS confidence, reasons FROM c"""


@query("d14_seeded_candidates", _PARTS, graph=False)
def d14_seeded_candidates(spark, d):
    """Parts that follow one another in finished orders call, feed or share state, by what came of the first; seeds are
    components of calls inside a type, components of state, and chains of data of at most five parts."""
    done = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber")
    x = star.table(spark, d, "lineitem").join(done, "l_orderkey", "left_semi").join(p, "l_partkey")
    x = x.withColumns({"next": F.lead("l_partkey").over(w), "name2": F.lead("p_name").over(w)}).where("next IS NOT NULL AND next <> l_partkey")
    one = lambda where, kind, data: x.where(where).select(F.lit(kind).alias("kind"), F.col("l_partkey").alias("src"), F.col("next").alias("dst"), data.cast("string").alias("data")).distinct()
    topo = one("l_returnflag = 'R'", "CALL", F.lit("")).unionByName(one("l_returnflag = 'A'", "DATA", F.col("p_size"))).unionByName(one("l_returnflag = 'N' AND p_name = name2", "STATE", F.col("p_name")))
    # parts and units are numbers until the end: a chain's name is as long as all of its parts'
    topo = settled(topo, "topology")
    modules = p.select(F.col("l_partkey").alias("id"), F.col("p_type").alias("module"))
    of = lambda end, name: modules.select(F.col("id").alias(end), F.col("module").alias(name))
    calls = topo.where("kind = 'CALL'").join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b")

    def region(rows: DataFrame, seed: str) -> DataFrame:
        """Components by their least member as text."""
        named = graph.components(rows.select(*[star.node_id("part", end).alias(end) for end in ("src", "dst")]))
        return named.select(F.lit(seed).alias("seed"), F.concat_ws(":", F.lit(seed), "component").alias("name"), F.substring_index("id", ":", -1).cast("long").alias("id"))

    regions = settled(region(calls, "call").unionByName(region(topo.where("kind = 'STATE'"), "state")), "regions")
    named = settled(regions.select("seed", "name").distinct().withColumn("unit", -1 - F.monotonically_increasing_id()), "names")
    data_ = settled(topo.where("kind = 'DATA'").select("src", "dst").distinct(), "data")
    chains = graph.chain_walks(data_, data_.select(F.col("src").alias("id")).distinct(), 5)
    chains = settled(chains.withColumn("unit", F.monotonically_increasing_id()), "walks")
    name = F.concat(F.lit("chain:"), F.array_join(F.transform("path", lambda k: F.concat(F.lit("part:"), k.cast("string"))), ">"))
    named = named.unionByName(chains.select(F.lit("chain").alias("seed"), name.alias("name"), "unit"))
    m = regions.join(named.where("unit < 0"), ["seed", "name"]).select("unit", "id").unionByName(chains.select("unit", F.explode("path").alias("id")))
    resolution = F.when(F.col("kind") == "STATE", "CANDIDATE_SET").otherwise("EXACT")
    edges = topo.select("kind", "src", "dst", resolution.alias("resolution"), F.lit("COMPLETE").alias("coverage"))
    f = settled(compare.features(m, edges, modules), "features").withColumn("declared", F.col("modules"))
    # only chains of one module are asked what leaves them
    few = m.join(f.where("unit >= 0 AND size >= 3 AND declared = 1").select("unit"), "unit", "left_semi")
    leaving = few.withColumnRenamed("id", "src").join(topo.where("kind = 'DATA'"), "src").join(few.withColumnRenamed("id", "dst"), ["unit", "dst"], "left_anti")
    leaving = leaving.groupBy("unit").agg(F.count_distinct("data").alias("data_out"))
    f = f.join(leaving, "unit", "left").na.fill(0, ["data_out"]).join(named, "unit").drop("unit").withColumnRenamed("name", "unit")
    return compare.ranked_candidates(f.withColumn("score", com.hard_score()))


@query("e1_tiered_distinct", f"""{_QNAMES}
, t AS (SELECT id, 0 AS tier, length(name) AS rank FROM qn WHERE name LIKE 'red%' UNION ALL SELECT id, 1, length(path) FROM qn WHERE path LIKE 'parts/ECONOMY%' UNION ALL SELECT id, 2, length(qname) FROM qn WHERE qname LIKE 'part.%r%')
SELECT id, tier::INTEGER AS tier, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, rank) AS k FROM t) WHERE k = 1""")
def e1_tiered_distinct(spark, d):
    """Three tiers of findings as one list: each node once, by its first tier and rank."""
    n = _named(spark, d)
    one = lambda where, tier, c: n.where(where).select("id", F.lit(tier).alias("tier"), F.length(c).alias("rank"))
    rows = one("name LIKE 'red%'", 0, "name").unionByName(one("path LIKE 'parts/ECONOMY%'", 1, "path")).unionByName(one("qname LIKE 'part.%r%'", 2, "qname"))
    return relational.first_wins(rows, ["id"], [F.col("tier"), F.col("rank")])
