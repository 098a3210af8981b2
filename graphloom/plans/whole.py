"""Queries that carry a survey operator to its whole: all labels, samples, budgets, roll-ups and errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import settled
from graphloom.operators import classify, design, graph, rollup, trace
from graphloom.plans.registry import ORACLES, query
from graphloom.plans.star import _REGIONS, _regions
from graphloom.sources import star


@query("b11_all_labels", """
WITH defs AS (SELECT lower(p_type) AS name, count(DISTINCT p_brand) AS n FROM part WHERE p_size > 47 GROUP BY 1), langs AS (SELECT DISTINCT lower(p_type) AS name FROM part WHERE p_size = 1)
, c AS (SELECT p_partkey, CASE WHEN p_size % 10 = 9 THEN p_name WHEN p_size % 2 = 0 THEN p_type || '_' ELSE p_type END AS callee, CASE WHEN p_brand < 'Brand#15' THEN 'c' WHEN p_brand < 'Brand#2' THEN 'fortran' ELSE 'python' END AS lang, p_size AS args FROM part)
SELECT p_partkey, CASE WHEN NOT regexp_matches(callee, '^[A-Za-z_$][A-Za-z0-9_$.]*$') THEN 'parser_noise' WHEN lang = 'fortran' AND lower(callee) = 'economy' THEN 'intrinsic' WHEN coalesce(n, 0) > 1 THEN 'ambiguous_symbol'
  WHEN callee LIKE '%\\_' ESCAPE '\\' AND l.name IS NOT NULL THEN 'cross_language' WHEN lang <> 'fortran' AND lower(callee) IN ('standard', 'promo', 'small_') THEN 'true_external' WHEN lang = 'fortran' AND args > 20 THEN 'call_vs_array_ambiguous' ELSE 'missing_target' END AS why
FROM c LEFT JOIN defs ON defs.name = lower(callee) LEFT JOIN langs l ON l.name = lower(rtrim(callee, '_'))""", graph=False)
def b11_all_labels(spark, d):
    p = star.table(spark, d, "part")
    callee = F.when(F.col("p_size") % 10 == 9, F.col("p_name")).when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("_"))).otherwise(F.col("p_type"))
    lang = F.when(F.col("p_brand") < "Brand#15", "c").when(F.col("p_brand") < "Brand#2", "fortran").otherwise("python")
    calls = p.select("p_partkey", callee.alias("callee"), lang.alias("language"), F.col("p_size").alias("args"))
    defs = p.where("p_size > 47").groupBy(F.lower("p_type").alias("name")).agg(F.count_distinct("p_brand").alias("definitions"))
    elsewhere = p.where("p_size = 1").select(F.lower("p_type").alias("name")).distinct()
    return design.labelled_calls(calls, defs, elsewhere, ["economy"], ["standard", "promo", "small_"], F.col("args") > 20).select("p_partkey", "why")


@query("d29_payloads", """
, r AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS k FROM data_events)
SELECT run, min(value) AS low, max(value) AS high, count_if(value <> 0)::BIGINT AS nonzero, bool_and(value = 0) AS all_zero, string_agg(value::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 8) AS first FROM r GROUP BY run""")
def d29_payloads(spark, d):
    return trace.payloads(star.data_events(spark, d), "run", "value", ["ts", "event_id"], 8)


@query("f1_rows", "SELECT id, path, row_number() OVER (ORDER BY path, name, id)::BIGINT - 1 AS seq FROM nodes")
def f1_rows(spark, d):
    return trace.numbered_everywhere(star.nodes(spark, d), ["path", "name", "id"]).select("id", "path", "seq")


@query("f2_page_of", "SELECT id, path, (SELECT count(*) FROM nodes) AS total FROM nodes ORDER BY path, id LIMIT 50 OFFSET 100")
def f2_page_of(spark, d):
    n = star.nodes(spark, d).select("id", "path")
    return n.orderBy("path", "id").offset(100).limit(50).withColumn("total", n.agg(F.count("*")).scalar())


@query("h1_neighbourhood", """
, hops(id, distance) AS (SELECT 'customer:1', 0 UNION SELECT CASE WHEN e.src = h.id THEN e.dst ELSE e.src END, h.distance + 1 FROM hops h JOIN edges e ON (e.src = h.id OR e.dst = h.id) AND e.kind = 'CALLS' WHERE h.distance < 2)
, near AS (SELECT id, distance FROM (SELECT id, min(distance) AS distance FROM hops GROUP BY id) ORDER BY distance, id LIMIT 40)
SELECT e.id, e.src, e.dst, e.kind, a.distance::INTEGER AS src_distance, b.distance::INTEGER AS dst_distance FROM edges e JOIN near a ON a.id = e.src JOIN near b ON b.id = e.dst""")
def h1_neighbourhood(spark, d):
    """The edges among the nearest nodes of a seed, within a budget of nodes."""
    edges = star.edges(spark, d)
    seeds = star.nodes(spark, d).where("id = 'customer:1'").select("id")
    return graph.induced(edges, graph.nearest(graph.bfs(edges.where("kind = 'CALLS'"), seeds, 2, "both"), 40)).select("id", "src", "dst", "kind", "src_distance", "dst_distance")


@query("h4_path_by_name", """
, hop AS (SELECT a.name AS x, b.name AS y, min(b.id) AS via FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL)
, w(name, distance) AS (SELECT 'ASIA', 0 UNION SELECT y, distance + 1 FROM w JOIN hop ON x = name WHERE distance < 4) SELECT name, min(distance)::INTEGER AS distance FROM w GROUP BY name""")
def h4_path_by_name(spark, d):
    """How far functions are from one by name, at most four calls deep."""
    e, n = star.edges(spark, d), star.nodes(spark, d)
    named = e.join(n.select(F.col("id").alias("src"), F.col("name").alias("x")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("y")), "dst")
    arcs = named.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return graph.bfs(arcs, n.where("name = 'ASIA'").select(F.col("name").alias("id")), 4, "out").select(F.col("id").alias("name"), "distance")


@query("h6_roll_up", """
, hops(id, distance) AS (SELECT id, 0 FROM nodes WHERE kind = 'PART' AND starts_with(path, 'parts/ECONOMY/Brand#1') UNION SELECT e.src, h.distance + 1 FROM hops h JOIN edges e ON e.dst = h.id AND e.kind = 'CALLS' WHERE h.distance < 2)
, best AS (SELECT id, min(distance) AS distance FROM hops GROUP BY id)
SELECT path, count(*) AS n, min(distance)::INTEGER AS nearest, min(id) AS first FROM best JOIN nodes USING (id) WHERE distance > 0 GROUP BY path""")
def h6_roll_up(spark, d):
    """Impact by file: how many nodes, how near the nearest, and the first of them."""
    n = star.nodes(spark, d)
    hit = graph.impact(star.links(spark, d), n.where("kind = 'PART' AND path LIKE 'parts/ECONOMY/Brand#1%'").select("id"), ["CALLS"], 2)
    return hit.where("distance > 0").join(n.select("id", "path"), "id").groupBy("path").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.min("id").alias("first"))


@query("h6_chains", """
, c(id, distance, chain) AS (SELECT id, 0, id FROM nodes WHERE kind = 'PART' AND starts_with(path, 'parts/ECONOMY/Brand#1') UNION ALL
  SELECT e.src, 1, min(e.src || '>' || nodes.id) FROM nodes JOIN edges e ON e.dst = nodes.id AND e.kind = 'CALLS' WHERE nodes.kind = 'PART' AND starts_with(path, 'parts/ECONOMY/Brand#1') GROUP BY e.src)
SELECT id, distance::INTEGER AS distance, chain FROM c""")
def h6_chains(spark, d):
    """The least chain to each node that a change reaches in one step, as ids joined by '>'."""
    n = star.nodes(spark, d)
    return graph.chains_to(star.edges(spark, d).where("kind = 'CALLS'"), n.where("kind = 'PART' AND path LIKE 'parts/ECONOMY/Brand#1%'").select("id"), 1)


@query("e4_pairs", """
, c AS (SELECT run, event_id, sum((op = 'WRITE')::INTEGER) OVER (PARTITION BY run ORDER BY ts, event_id)::BIGINT AS cluster FROM data_events), call AS (SELECT run, event_id AS call, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS cluster FROM data_events WHERE op = 'READ_WRITE')
SELECT run, event_id, cluster, call FROM c JOIN call USING (run, cluster)""")
def e4_pairs(spark, d):
    """The i-th cluster of a run goes with its i-th call."""
    e = star.data_events(spark, d)
    rows = trace.clusters(e, ["run"], ["ts", "event_id"], F.col("op") == "WRITE").select("run", "event_id", "cluster")
    calls = trace.numbered(e.where("op = 'READ_WRITE'"), ["run"], ["ts", "event_id"], "k").select("run", F.col("event_id").alias("call"), (F.col("k") + 1).alias("cluster"))
    return rows.join(calls, ["run", "cluster"])


@query("e5_integrity", """
, s AS (SELECT run, event_id, row_number() OVER w AS k, CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END AS step FROM data_events WINDOW w AS (PARTITION BY run ORDER BY ts, event_id))
, r AS (SELECT run, sum(step) AS open, min(low) AS low, count(*) AS n FROM (SELECT *, sum(step) OVER (PARTITION BY run ORDER BY k) AS low FROM s) GROUP BY run)
SELECT run, CASE WHEN low < 0 THEN 'exit_without_enter' WHEN open > 0 THEN 'unclosed_frames' ELSE 'ok' END AS integrity, greatest(0, open)::BIGINT AS unclosed FROM r""")
def e5_integrity(spark, d):
    """Runs whose exits outnumber their enters somewhere, or whose frames stay open."""
    rows = trace.numbered(star.data_events(spark, d), ["run"], ["ts", "event_id"], "k")
    rows = rows.select("run", "k", F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1).alias("step"))
    return trace.integrity(rows, ["run"], "k")


@query("e12_signatures", """
, e AS (SELECT src, dst, weight, md5(id)[1:1] NOT IN ('0', '1') AS kept FROM edges WHERE kind = 'CALLS'), a AS (SELECT dst, row_number() OVER (ORDER BY sum(weight) DESC, dst) AS r FROM e GROUP BY dst), b AS (SELECT dst, row_number() OVER (ORDER BY sum(weight) DESC, dst) AS r FROM e WHERE kept GROUP BY dst)
, x AS (SELECT dst FROM a WHERE r <= 10), y AS (SELECT dst FROM b WHERE r <= 10)
SELECT (SELECT count(*) FROM x JOIN y USING (dst)) AS shared, round((SELECT count(*) FROM x JOIN y USING (dst)) / (SELECT count(*) FROM (SELECT dst FROM x UNION SELECT dst FROM y)), 6) AS jaccard""")
def e12_signatures(spark, d):
    """How alike the ten heaviest targets are before and after a tenth of the edges is dropped."""
    e = star.edges(spark, d).where("kind = 'CALLS'")
    top = lambda rows: rows.groupBy("dst").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "dst").limit(10).select("dst")
    both = top(e).withColumn("a", F.lit(1)).join(top(e.where(~F.substring(F.md5("id"), 1, 1).isin("0", "1"))).withColumn("b", F.lit(1)), "dst", "full_outer")
    shared = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.agg(shared.alias("shared"), F.round(shared / F.count("*"), 6).alias("jaccard"))


@query("d9_tokens", f"""{_REGIONS}
, cross_ AS (SELECT a.unit, 'out' AS role, p_brand AS token, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN member a ON a.id = 'supplier:' || l_suppkey JOIN member b ON b.id = 'customer:' || o_custkey AND a.unit <> b.unit GROUP BY ALL
  UNION ALL SELECT b.unit, 'in', p_brand, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN member a ON a.id = 'supplier:' || l_suppkey JOIN member b ON b.id = 'customer:' || o_custkey AND a.unit <> b.unit GROUP BY ALL)
SELECT unit, role, token, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY unit, role ORDER BY n DESC, token) AS rank FROM cross_) WHERE rank <= 12""")
def d9_tokens(spark, d):
    """The first twelve tokens that cross a unit's border, by direction."""
    m = _regions(spark, d)
    items = star.table(spark, d, "lineitem").join(star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    items = items.join(star.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = items.groupBy("l_suppkey", "o_custkey", F.col("p_brand").alias("token")).agg(F.count("*").alias("n")).select(star.node_id("supplier", "l_suppkey").alias("src"), star.node_id("customer", "o_custkey").alias("dst"), "token", "n")
    j = pairs.join(m.toDF("src", "su"), "src").join(m.toDF("dst", "du"), "dst").where("su <> du")
    rows = j.select(F.explode(F.array(F.struct(F.col("su").alias("unit"), F.lit("out").alias("role")), F.struct(F.col("du").alias("unit"), F.lit("in").alias("role")))).alias("x"), "token", "n")
    by = rows.groupBy("x.unit", "x.role", "token").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("unit", "role").orderBy(F.desc("n"), "token")
    return by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 12)


@query("d2_ranked", f"""{_REGIONS}
, o AS (SELECT a.unit AS src_unit, b.unit AS dst_unit, count(*) AS n FROM edges t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst GROUP BY ALL)
SELECT src_unit, dst_unit, n, row_number() OVER (ORDER BY n DESC, src_unit, dst_unit)::INTEGER AS rank, (SELECT sum(n) FROM o)::BIGINT AS total, (SELECT count(*) FROM o) > 8 AS truncated FROM o QUALIFY rank <= 8""")
def d2_ranked(spark, d):
    """The heaviest pairs of units, with the total of all and whether there are more."""
    o = settled(rollup.overview(star.edges(spark, d), _regions(spark, d)).groupBy("src_unit", "dst_unit").agg(F.sum("n").alias("n")), "overview")
    first = o.orderBy(F.desc("n"), "src_unit", "dst_unit").limit(8)
    # at most eight rows
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "src_unit", "dst_unit")))
    return ranked.withColumns({"total": o.agg(F.sum("n")).scalar(), "truncated": o.agg(F.count("*") > 8).scalar()})


def _rounds(n: int) -> str:
    """The twin of n rounds of label propagation."""
    out = ", arc AS (SELECT src, dst, weight FROM trades UNION ALL SELECT dst, src, weight FROM trades), l0 AS (SELECT DISTINCT src AS id, src AS label FROM arc)"
    for k in range(n):
        out += f", v{k} AS (SELECT a.src AS id, label, sum(weight) AS w FROM arc a JOIN l{k} ON a.dst = l{k}.id GROUP BY ALL), l{k + 1} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM v{k}) WHERE r = 1)"
    return out


@query("h23_label_rounds", f"{_rounds(5)} SELECT id, label FROM l5")
def h23_label_rounds(spark, d):
    return design.propagated(star.strong_trades(spark, d), 5)


# the older query is the same rounds over the same graph
ORACLES["h23_label_propagation"] = ORACLES["h23_label_rounds"]


@query("b21_stage_kinds", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents)
SELECT name, CASE WHEN starts_with(name, 'config') THEN 'CONFIGURATION' WHEN starts_with(name, 'reinit') THEN 'INITIALIZATION' WHEN starts_with(name, 'rmatrix') THEN 'COMPUTE' WHEN starts_with(name, 'rec') THEN 'TRANSFORM'
  WHEN starts_with(name, 'transition') THEN 'POSTPROCESS' WHEN starts_with(name, 'cetable') OR starts_with(name, 'ci') THEN 'OUTPUT' WHEN starts_with(name, 'free') OR starts_with(name, 'join') THEN 'OTHER'
  WHEN starts_with(name, 'set') OR starts_with(name, 'optimize') OR starts_with(name, 'structure') THEN 'PREPARATION' ELSE 'OTHER' END AS kind FROM w""", graph=False)
def b21_stage_kinds(spark, d):
    from graphloom.operators import compare

    words = star.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("name")).distinct()
    return words.select("name", compare.stage_kind(F.col("name")).alias("kind"))


@query("a9_logs", """
WITH t AS (SELECT event_id, 1::BIGINT AS line, 'src/' || user_id || '.c' AS file, 'error' AS severity, 'undefined reference to ' || event_type AS message, 'UNDEFINED_SYMBOL' AS category FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 3, 'src/' || user_id || '.c', 'error', 'rank mismatch', 'TYPE_OR_INTERFACE_MISMATCH' FROM events WHERE event_type IN ('click', 'view'))
SELECT * FROM t UNION ALL SELECT event_id, 0, NULL, 'error', NULL, 'UNCLASSIFIED' FROM events WHERE event_type NOT IN ('click', 'view')""", graph=False)
def a9_logs(spark, d):
    """Logs of which some hold no message that is known: these give one row that says so."""
    from graphloom.operators import files

    first = F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".c:12:3: error: undefined reference to "), F.col("event_type"))
    text = F.when(F.col("event_type").isin("click", "view"), F.concat_ws("\n", first, F.lit("  |"), F.lit("fatal ERROR: rank mismatch"))).otherwise(F.lit("all went well"))
    return files.logs(star.table(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text")


@query("k6_d002_open", f"""
SELECT 'D002' AS rule, 'INFO' AS severity, CASE WHEN count_if(l_returnflag <> 'N') = 0 THEN 'UNKNOWN' ELSE 'ESTABLISHED' END AS status, 'supplier:' || l_suppkey AS subject, count(*)::VARCHAR AS token FROM lineitem WHERE l_quantity > 40 AND l_discount > 0.07 GROUP BY l_suppkey""", graph=False)
def k6_d002_open(spark, d):
    """For each supplier, whether its data checks can be established at all: only from lines that are closed."""
    rows = star.table(spark, d, "lineitem").where("l_quantity > 40 AND l_discount > 0.07")
    by = rows.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("sure"), F.count("*").alias("n"))
    return by.select(F.lit("D002").alias("rule"), F.lit("INFO").alias("severity"), F.when(F.col("sure") == 0, "UNKNOWN").otherwise("ESTABLISHED").alias("status"), star.node_id("supplier", "l_suppkey").alias("subject"), F.col("n").cast("string").alias("token"))


@query("k12_part_cycles", """
WITH RECURSIVE succ AS (SELECT p AS src, q AS dst FROM (SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS q FROM lineitem WHERE l_quantity > 42) WHERE q IS NOT NULL AND p <> q GROUP BY ALL)
SELECT 'part:' || a.src || '>part:' || a.dst AS path FROM succ a JOIN succ b ON b.src = a.dst AND b.dst = a.src WHERE 'part:' || a.src < 'part:' || a.dst
UNION ALL SELECT 'part:' || a.src || '>part:' || a.dst || '>part:' || b.dst FROM succ a JOIN succ b ON b.src = a.dst JOIN succ c ON c.src = b.dst AND c.dst = a.src WHERE 'part:' || a.src < 'part:' || a.dst AND 'part:' || a.src < 'part:' || b.dst AND a.dst <> b.dst""", graph=False)
def k12_part_cycles(spark, d):
    return graph.cycles(star.successions(spark, d), 3).select("path")
