"""Queries of the operators over the star graph, one for each operator, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import classify, diff, graph, relational, rollup, rules, search, trace
from graphloom.plans.registry import query
from graphloom.sources import star

#: Date ranges of two overlapping snapshots of orders.
BEFORE, AFTER = ("1995-01-01", "1998-01-01"), ("1996-01-01", "1999-01-01")
_RANGE = "o_orderdate >= TIMESTAMP '{}' AND o_orderdate < TIMESTAMP '{}'"


def _snapshots(spark, d):
    """The later snapshot has urgent orders moved to high priority, so that some rows change."""
    a, b = star.snapshot(spark, d, *BEFORE), star.snapshot(spark, d, *AFTER)
    moved = F.when(F.col("o_orderpriority") == "1-URGENT", "2-HIGH").otherwise(F.col("o_orderpriority"))
    return a, b.withColumn("o_orderpriority", moved)


_SNAPSHOTS = f"""
, sa AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE {_RANGE.format(*BEFORE)})
, sb AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN '2-HIGH' ELSE o_orderpriority END AS o_orderpriority
         FROM orders WHERE {_RANGE.format(*AFTER)})
"""


@query("h1_bfs", """
, hops(id, distance) AS (
  SELECT 'customer:1', 0 UNION
  SELECT CASE WHEN e.src = h.id THEN e.dst ELSE e.src END, h.distance + 1 FROM hops h JOIN edges e ON (e.src = h.id OR e.dst = h.id) AND e.kind = 'CALLS' WHERE h.distance < 2
) SELECT h.id, min(distance)::INTEGER AS distance, any_value(n.name) AS name, any_value(n.kind) AS kind FROM hops h JOIN nodes n USING (id) GROUP BY h.id""")  # fmt: skip
def h1_bfs(spark, d):
    seeds = star.nodes(spark, d).where("id = 'customer:1'").select("id")
    near = graph.bfs(star.links(spark, d).where("kind = 'CALLS'"), seeds, 2, "both")
    return near.join(star.nodes(spark, d).select("id", "name", "kind"), "id").select("id", "distance", "name", "kind")


@query("a3_snapshot_rows", f"{_SNAPSHOTS} SELECT * FROM sb")
def a3_snapshot_rows(spark, d):
    return _snapshots(spark, d)[1]


@query("a4_new_edges", """
, old AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'N')
SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'N'
EXCEPT SELECT * FROM old""")
def a4_new_edges(spark, d):
    items = star.table(spark, d, "lineitem")
    pair = lambda rows: rows.select(star.node_id("order", "l_orderkey").alias("src"), star.node_id("part", "l_partkey").alias("dst")).dropDuplicates()
    return pair(items.where("l_returnflag <> 'N'")).join(pair(items.where("l_returnflag = 'N'")), ["src", "dst"], "left_anti")


@query("a5_upsert", f"""{_SNAPSHOTS}
SELECT coalesce(sb.o_orderkey, sa.o_orderkey) AS o_orderkey, CASE WHEN sb.o_orderkey IS NULL THEN sa.o_orderpriority ELSE sb.o_orderpriority END AS o_orderpriority,
  ((sa.o_orderkey IS NOT NULL)::INTEGER + (sb.o_orderkey IS NOT NULL)::INTEGER)::BIGINT AS occurrences
FROM sa FULL JOIN sb ON sa.o_orderkey = sb.o_orderkey""")
def a5_upsert(spark, d):
    a, b = _snapshots(spark, d)
    rows = a.withColumn("version", F.lit(1)).unionByName(b.withColumn("version", F.lit(2)))
    return rows.groupBy("o_orderkey").agg(F.max_by("o_orderpriority", "version").alias("o_orderpriority"), F.count("*").alias("occurrences"))


@query("a15_view_export", "SELECT id, kind, src, dst FROM edges WHERE kind = 'CONTAINS' ORDER BY id LIMIT 500")
def a15_view_export(spark, d):
    return star.edges(spark, d).where("kind = 'CONTAINS'").select("id", "kind", "src", "dst").orderBy("id").limit(500)


@query("b1_point_lookup", "SELECT * FROM nodes WHERE id = 'supplier:7'")
def b1_point_lookup(spark, d):
    return star.nodes(spark, d).where("id = 'supplier:7'")


@query("b2_alias_lookup", """
, keys AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'no such name')
SELECT name, CASE WHEN count(id) = 0 THEN 'NOT_FOUND' WHEN count(id) = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status,
  CASE WHEN count(id) = 1 THEN min(id) END AS id, count(id) AS n
FROM keys LEFT JOIN nodes USING (name) GROUP BY name""")
def b2_alias_lookup(spark, d):
    keys = star.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    keys = keys.unionByName(keys.agg(F.lit("no such name").alias("name")))
    return relational.lookup(keys, star.nodes(spark, d), ["name"])


@query("b3_path_prefix", "SELECT id, path FROM nodes WHERE path = 'ASIA/NATION_2' OR starts_with(path, 'ASIA/NATION_2/')")
def b3_path_prefix(spark, d):
    return star.nodes(spark, d).where(relational.within(F.col("path"), "ASIA/NATION_2")).select("id", "path")


@query("b4_paths_in_list", """
SELECT id, path FROM nodes WHERE path IN (SELECT 'parts/' || p_type || '/' || p_brand FROM part WHERE p_size > 48)""")
def b4_paths_in_list(spark, d):
    wanted = star.table(spark, d, "part").where("p_size > 48").select(F.concat_ws("/", F.lit("parts"), "p_type", "p_brand").alias("path"))
    return star.nodes(spark, d).join(wanted, "path", "left_semi").select("id", "path")


@query("b6_post_filters", "SELECT id FROM nodes WHERE path LIKE '%/Brand#7' AND contains(lower(kind), 'par') AND language = 'Brand#7'")
def b6_post_filters(spark, d):
    n = star.nodes(spark, d)
    return n.where(F.col("path").endswith("/Brand#7") & F.contains(F.lower("kind"), F.lit("par")) & (F.col("language") == "Brand#7")).select("id")


@query("b7_current", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def b7_current(spark, d):
    done = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.latest(done, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("b8_tree_level", """
SELECT split_part(path, '/', 2) AS entry, count(*) AS n FROM nodes WHERE starts_with(path, 'EUROPE/') GROUP BY 1""")
def b8_tree_level(spark, d):
    below = star.nodes(spark, d).where(F.col("path").startswith("EUROPE/"))
    return below.groupBy(F.element_at(F.split("path", "/"), 2).alias("entry")).agg(F.count("*").alias("n"))


@query("b9_file_symbols", "SELECT path, id, (row_number() OVER (PARTITION BY path ORDER BY ordinal, name, id) - 1)::BIGINT AS seq FROM nodes WHERE kind = 'PART'")
def b9_file_symbols(spark, d):
    parts = star.nodes(spark, d).where("kind = 'PART'")
    return trace.numbered(parts, ["path"], ["ordinal", "name", "id"]).select("path", "id", "seq")


@query("b10_join_key", "SELECT event_id, upper(trim('__' || event_type || '_', '_')) AS join_key FROM events", graph=False)
def b10_join_key(spark, d):
    return star.table(spark, d, "events").select("event_id", classify.join_key(F.concat(F.lit("__"), "event_type", F.lit("_"))).alias("join_key"))


_EXTENSIONS = ["f90", "c", "hpp", "py", "go", "tsx", "java", "md", "H", "mjs"]


@query("b13_language", f"""
SELECT page_id, CASE ext WHEN 'f90' THEN 'fortran' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'hpp' THEN 'cpp' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go'
  WHEN 'tsx' THEN 'typescript' WHEN 'mjs' THEN 'typescript' WHEN 'java' THEN 'java' ELSE '' END AS language
FROM (SELECT page_id, lower({_EXTENSIONS!r}[(page_id % 10 + 1)::INTEGER]) AS ext FROM pages)""", graph=False)  # fmt: skip
def b13_language(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("page_id") % 10 + 1).cast("int"))
    return star.table(spark, d, "pages").select("page_id", classify.language(F.concat(F.col("url"), F.lit("/x."), ext)).alias("language"))


@query("b14_resource", """
SELECT page_id, CASE WHEN contains(t, 'printf') OR contains(t, 'fopen') OR contains(t, 'open(') OR starts_with(t, 'fwrite') OR starts_with(t, 'fread') THEN 'FileSystem'
  WHEN contains(t, 'insert') OR contains(t, 'select') OR contains(t, 'sql') OR contains(t, 'db_') THEN 'Database'
  WHEN contains(t, 'socket') OR contains(t, 'send') OR contains(t, 'recv') OR contains(t, 'http') THEN 'Network'
  WHEN contains(t, 'gpu') OR contains(t, 'cuda') THEN 'GPU' END AS resource
FROM (SELECT page_id, lower(url) AS t FROM pages)""", graph=False)
def b14_resource(spark, d):
    return star.table(spark, d, "pages").select("page_id", classify.resource(F.col("url")).alias("resource"))


@query("b16_family", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') THEN 'small' WHEN starts_with(p_name, 's') THEN 's' WHEN starts_with(p_name, 'red') THEN 'red' END AS family FROM part", graph=False)
def b16_family(spark, d):
    return star.table(spark, d, "part").select("p_partkey", classify.family(F.col("p_name"), ["small", "s", "red"]).alias("family"))


_MESSAGES = ["No such file or directory", "undefined reference to x", "duplicate symbol y", "conflicting types for z", "expected ;", "internal"]


@query("b17_diagnostic", """
SELECT event_id, ['MISSING_INCLUDE_OR_MODULE', 'UNDEFINED_SYMBOL', 'DUPLICATE_SYMBOL', 'TYPE_OR_INTERFACE_MISMATCH', 'SYNTAX_ERROR', 'COMPILE_OR_LINK_ERROR'][(event_id % 6 + 1)::INTEGER] AS category
FROM events""", graph=False)
def b17_diagnostic(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6 + 1).cast("int"))
    return star.table(spark, d, "events").select("event_id", classify.diagnostic(F.concat_ws(" ", message, "event_type")).alias("category"))


_FACTS = """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'OBSERVED' WHEN 'signup' THEN 'RESOLVED' WHEN 'click' THEN 'INFERRED' ELSE 'HEURISTIC' END AS truth,
  CASE event_id % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'CANDIDATE_SET' ELSE 'UNKNOWN' END AS resolution FROM events"""


def _facts(spark, d):
    truth = F.when(F.col("event_type") == "purchase", "OBSERVED").when(F.col("event_type") == "signup", "RESOLVED").when(F.col("event_type") == "click", "INFERRED").otherwise("HEURISTIC")
    resolution = F.element_at(F.array(F.lit("EXACT"), F.lit("CANDIDATE_SET"), F.lit("UNKNOWN")), (F.col("event_id") % 3 + 1).cast("int"))
    return star.table(spark, d, "events").select("event_id", "user_id", truth.alias("truth"), resolution.alias("resolution"))


@query("b18_layer", f"SELECT event_id, CASE WHEN truth IN ('OBSERVED', 'RESOLVED') AND resolution = 'EXACT' THEN 'T0' ELSE 'T1' END AS layer FROM ({_FACTS})", graph=False)
def b18_layer(spark, d):
    return _facts(spark, d).select("event_id", classify.layer(F.col("truth"), F.col("resolution")).alias("layer"))


@query("b20_truth_guard", f"SELECT event_id, CASE WHEN truth = 'RESOLVED' AND event_id % 2 = 1 THEN 'INFERRED' ELSE truth END AS truth FROM ({_FACTS})", graph=False)
def b20_truth_guard(spark, d):
    seen = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("producer_return"), F.lit("consumer_parameter"))).otherwise(F.array(F.lit("producer_return")))
    return _facts(spark, d).select("event_id", classify.guarded(F.col("truth"), seen).alias("truth"))


@query("b22_freshness", f"""{_SNAPSHOTS}
SELECT sa.o_orderkey, CASE WHEN sb.o_orderkey IS NULL THEN 'UNKNOWN' WHEN sa.o_orderpriority = sb.o_orderpriority AND sa.o_orderstatus = sb.o_orderstatus THEN 'CURRENT' ELSE 'STALE' END AS freshness
FROM sa LEFT JOIN sb ON sa.o_orderkey = sb.o_orderkey""")
def b22_freshness(spark, d):
    a, b = _snapshots(spark, d)
    j = a.join(b.select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")), "o_orderkey", "left")
    return j.select("o_orderkey", classify.freshness([(F.col("o_orderpriority"), F.col("p")), (F.col("o_orderstatus"), F.col("s"))]).alias("freshness"))


@query("c1_adjacency", """
SELECT e.src AS node, 'out' AS direction, e.kind, e.dst AS other, n.kind AS other_kind, n.name AS other_name FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.kind <> 'USES'
UNION ALL SELECT e.dst, 'in', e.kind, e.src, n.kind, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind <> 'USES'""")
def c1_adjacency(spark, d):
    return relational.adjacency(star.nodes(spark, d), star.edges(spark, d), "both", ["CALLS", "CONTAINS"])


@query("c2_without_touching", """
, gone AS (SELECT id FROM nodes WHERE starts_with(path, 'ASIA/'))
SELECT id FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def c2_without_touching(spark, d):
    gone = star.nodes(spark, d).where(F.col("path").startswith("ASIA/")).select("id")
    return relational.without_touching(star.edges(spark, d), gone).select("id")


@query("c3_orphans", f"{_SNAPSHOTS} SELECT o_orderkey, o_custkey FROM sa WHERE o_orderkey NOT IN (SELECT o_orderkey FROM sb)")
def c3_orphans(spark, d):
    a, b = _snapshots(spark, d)
    return relational.orphans(a, b, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("c4_delete_except", """
SELECT id FROM nodes WHERE kind = 'CUSTOMER' AND NOT (starts_with(path, 'AFRICA/') AND language <> 'MACHINERY')""")
def c4_delete_except(spark, d):
    n = star.nodes(spark, d).where("kind = 'CUSTOMER'")
    keep = n.where("language = 'MACHINERY'").select("id")
    doomed = n.where(F.col("path").startswith("AFRICA/")).join(keep, "id", "left_anti").select("id")
    return n.join(doomed, "id", "left_anti").select("id")


@query("c6_unique_definitions", "SELECT name, language, min(id) AS id FROM nodes WHERE kind = 'PART' GROUP BY name, language HAVING count(*) = 1")
def c6_unique_definitions(spark, d):
    return relational.unique_definitions(star.nodes(spark, d).where("kind = 'PART'"), ["name", "language"])


@query("c8_cascade", """
, refs AS (SELECT p_partkey AS ref, p_name AS name, p_brand AS brand, p_type AS type FROM part)
, a AS (SELECT p_name AS name, p_brand AS brand, p_type AS type, count(*) AS n, min('part:' || p_partkey) AS t FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
, b AS (SELECT p_name AS name, p_brand AS brand, count(*) AS n, min('part:' || p_partkey) AS t FROM part WHERE p_size % 3 = 0 GROUP BY ALL)
, c AS (SELECT p_name AS name, count(*) AS n, min('part:' || p_partkey) AS t FROM part WHERE p_size % 5 = 0 GROUP BY ALL)
, j AS (SELECT ref, coalesce(a.n, 0) AS an, a.t AS ta, coalesce(b.n, 0) AS bn, b.t AS tb, coalesce(c.n, 0) AS cn, c.t AS tc
  FROM refs LEFT JOIN a USING (name, brand, type) LEFT JOIN b USING (name, brand) LEFT JOIN c USING (name))
SELECT ref, CASE WHEN an = 1 THEN 'same_file' WHEN an > 1 THEN 'ambiguous' WHEN bn = 1 THEN 'imported' WHEN bn > 1 THEN 'ambiguous' WHEN cn = 1 THEN 'global_unique' WHEN cn > 1 THEN 'ambiguous' ELSE 'unresolved' END AS tier,
  CASE WHEN an = 1 THEN 0.95 WHEN an > 1 THEN 0.0 WHEN bn = 1 THEN 0.9 WHEN bn > 1 THEN 0.0 WHEN cn = 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN an = 1 THEN ta WHEN an > 1 THEN NULL WHEN bn = 1 THEN tb WHEN bn > 1 THEN NULL WHEN cn = 1 THEN tc END AS target
FROM j""")
def c8_cascade(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_size", star.node_id("part", "p_partkey").alias("target"))
    tiers = [
        ("same_file", 0.95, p.where("p_size % 2 = 0"), ["name", "brand", "type"]),
        ("imported", 0.9, p.where("p_size % 3 = 0"), ["name", "brand"]),
        ("global_unique", 0.7, p.where("p_size % 5 = 0"), ["name"]),
    ]
    return relational.cascade(p.select("ref", "name", "brand", "type"), tiers, "ref")


@query("c9_innermost", """
, spans AS (SELECT path, id, ordinal AS start, ordinal + 40 AS "end" FROM nodes WHERE kind = 'PART')
, points AS (SELECT path, id AS point, ordinal + 7 AS line FROM nodes WHERE kind = 'PART')
SELECT point, arg_max(spans.id, (start, spans.id)) FILTER (WHERE line BETWEEN start AND "end") AS span_id FROM points JOIN spans USING (path) GROUP BY point""")
def c9_innermost(spark, d):
    n = star.nodes(spark, d).where("kind = 'PART'")
    spans = n.select("path", "id", F.col("ordinal").alias("start"), (F.col("ordinal") + 40).alias("end"))
    points = n.select("path", F.col("id").alias("point"), (F.col("ordinal") + 7).alias("line"))
    return relational.innermost(points, spans, "point", "line")


@query("c16_planes", """
, s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('A', 'N'))
, o AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('R', 'N'))
SELECT coalesce(s.o, o.o) AS l_orderkey, coalesce(s.p, o.p) AS l_partkey, CASE WHEN s.o IS NULL THEN 'observed_only' WHEN o.o IS NULL THEN 'static_only' ELSE 'both' END AS plane
FROM s FULL JOIN o ON s.o = o.o AND s.p = o.p""")
def c16_planes(spark, d):
    i = star.table(spark, d, "lineitem")
    return relational.planes(i.where("l_returnflag IN ('A', 'N')"), i.where("l_returnflag IN ('R', 'N')"), ["l_orderkey", "l_partkey"])


@query("c17_positional", """
, a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS pos FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
, f AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS pos FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))
SELECT l_orderkey, pos - 1 AS pos, l_partkey, l_suppkey FROM a JOIN f USING (l_orderkey, pos)""")
def c17_positional(spark, d):
    i = star.table(spark, d, "lineitem")
    side = lambda c: trace.numbered(i.select("l_orderkey", c).distinct(), ["l_orderkey"], [c], "pos")
    return side("l_partkey").join(side("l_suppkey"), ["l_orderkey", "pos"]).select("l_orderkey", "pos", "l_partkey", "l_suppkey")


@query("c22_first_wins", f"""{_SNAPSHOTS}
SELECT o_orderkey, arg_min(o_orderpriority, r) AS o_orderpriority FROM (SELECT *, 1 AS r FROM sa UNION ALL SELECT *, 2 FROM sb) GROUP BY o_orderkey""")
def c22_first_wins(spark, d):
    a, b = _snapshots(spark, d)
    rows = a.withColumn("priority", F.lit(1)).unionByName(b.withColumn("priority", F.lit(2)))
    return relational.first_wins(rows, ["o_orderkey"], [F.col("priority")]).select("o_orderkey", "o_orderpriority")


@query("c23_drop_shadowed", f"""
, f AS ({_FACTS})
SELECT event_id FROM f JOIN events USING (event_id) WHERE resolution = 'EXACT' OR (user_id, event_type) NOT IN (SELECT user_id, event_type FROM f JOIN events USING (event_id) WHERE resolution = 'EXACT')""")
def c23_drop_shadowed(spark, d):
    f = _facts(spark, d).join(star.table(spark, d, "events").select("event_id", "event_type"), "event_id")
    exact = f.where("resolution = 'EXACT'")
    open_ = f.where("resolution <> 'EXACT'").join(exact.select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")
    return exact.select("event_id").unionByName(open_.select("event_id"))


@query("c25_sharing_pairs", """
, held AS (SELECT DISTINCT s_nationkey AS id, l_returnflag || l_linestatus || p_type AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT a.id AS a, b.id AS b, count(*) AS shared FROM held a JOIN held b ON a.t = b.t AND a.id < b.id GROUP BY ALL""")
def c25_sharing_pairs(spark, d):
    i = star.table(spark, d, "lineitem").join(star.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(star.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = i.select("s_nationkey", F.concat("l_returnflag", "l_linestatus", "p_type").alias("token"))
    return relational.sharing_pairs(rows, "s_nationkey", "token")


@query("d1_statistics", """
SELECT 'node_kind' AS what, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM nodes GROUP BY language
UNION ALL SELECT 'edge_kind', kind, count(*) FROM edges GROUP BY kind""")
def d1_statistics(spark, d):
    return rollup.statistics(star.nodes(spark, d), star.edges(spark, d))


def _regions(spark, d):
    return star.nodes(spark, d).where("kind IN ('NATION', 'CUSTOMER', 'SUPPLIER')").select("id", F.substring_index("path", "/", 1).alias("unit"))


_REGIONS = ", member AS (SELECT id, split_part(path, '/', 1) AS unit FROM nodes WHERE kind IN ('NATION', 'CUSTOMER', 'SUPPLIER'))"


@query("d2_overview", f"""{_REGIONS}
SELECT a.unit AS src_unit, b.unit AS dst_unit, t.weight % 2 = 0 AS even, count(*) AS n FROM all_trades t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst GROUP BY ALL""")
def d2_overview(spark, d):
    e = star.trades(spark, d).withColumn("kind", F.col("weight") % 2 == 0)
    return rollup.overview(e, _regions(spark, d)).withColumnRenamed("kind", "even")


@query("d3_prefix_counts", """
SELECT array_to_string(parts[1:i], '/') AS directory, count(*) AS n
FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM (SELECT string_split(path, '/') AS parts FROM nodes)) GROUP BY 1""")
def d3_prefix_counts(spark, d):
    return rollup.prefix_counts(star.nodes(spark, d))


@query("d5_resolution_counts", f"SELECT user_id, count_if(resolution = 'EXACT')::BIGINT AS exact, count_if(resolution = 'CANDIDATE_SET')::BIGINT AS candidates, count_if(resolution = 'UNKNOWN')::BIGINT AS unknown FROM ({_FACTS}) JOIN events USING (event_id) GROUP BY user_id", graph=False)
def d5_resolution_counts(spark, d):
    is_ = lambda x: F.count_if(F.col("resolution") == x)
    return _facts(spark, d).groupBy("user_id").agg(is_("EXACT").alias("exact"), is_("CANDIDATE_SET").alias("candidates"), is_("UNKNOWN").alias("unknown"))


@query("d7_witnesses", """
SELECT l_suppkey, count(*) AS n, array_to_string(list_sort(list_distinct(list(lpad(l_partkey::VARCHAR, 9, '0'))))[1:3], ',') AS first FROM lineitem GROUP BY l_suppkey""", graph=False)
def d7_witnesses(spark, d):
    return rollup.witnesses(star.table(spark, d, "lineitem"), ["l_suppkey"], F.lpad(F.col("l_partkey").cast("string"), 9, "0"))


@query("d8_hubs", """
, fan AS (SELECT dst AS id, count(*) AS fan_in FROM edges GROUP BY dst)
SELECT id, coalesce(fan_in, 0) AS fan_in FROM nodes LEFT JOIN fan USING (id) WHERE fan_in >= 25 OR contains(lower(name), 'gear') OR contains(lower(name), 'ring')""")
def d8_hubs(spark, d):
    return rollup.hubs(star.edges(spark, d), star.nodes(spark, d), 25, ["gear", "ring"]).select("id", "fan_in")


@query("d9_boundary", f"""{_REGIONS}
, e AS (SELECT 'TRADES' AS kind, a.unit AS su, b.unit AS du FROM all_trades t LEFT JOIN member a ON a.id = t.src LEFT JOIN member b ON b.id = t.dst)
, x AS (SELECT kind, su AS unit, 'out' AS side, coalesce(su = du, false) AS inside FROM e UNION ALL SELECT kind, du, 'in', coalesce(su = du, false) FROM e)
SELECT unit, kind, count_if(inside AND side = 'out')::BIGINT AS internal, count_if(NOT inside AND side = 'out')::BIGINT AS outgoing, count_if(NOT inside AND side = 'in')::BIGINT AS incoming
FROM x WHERE unit IS NOT NULL GROUP BY ALL""")
def d9_boundary(spark, d):
    return rollup.boundary(star.trades(spark, d).withColumn("kind", F.lit("TRADES")), _regions(spark, d))


@query("d18_modularity", f"""{_REGIONS}
, w AS (SELECT a.unit AS su, b.unit AS du, weight FROM all_trades t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst)
, m AS (SELECT sum(weight)::DOUBLE AS m FROM w)
, i AS (SELECT su AS unit, sum(CASE WHEN su = du THEN weight ELSE 0 END)::DOUBLE AS inside, sum(weight)::DOUBLE AS o FROM w GROUP BY su)
, j AS (SELECT du AS unit, sum(weight)::DOUBLE AS n FROM w GROUP BY du)
SELECT round(sum(coalesce(inside, 0) / m - pow((coalesce(o, 0) + coalesce(n, 0)) / (2 * m), 2)), 9) AS modularity FROM i FULL JOIN j USING (unit), m""")
def d18_modularity(spark, d):
    return rollup.modularity(star.trades(spark, d), _regions(spark, d))


@query("d21_shared_core", """
SELECT l_suppkey, count(DISTINCT p_type) AS families FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey HAVING count(DISTINCT p_type) >= 2""", graph=False)
def d21_shared_core(spark, d):
    """Suppliers that parts of several families call."""
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    i = star.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(p, "l_partkey")
    return i.groupBy("l_suppkey").agg(F.count_distinct("p_type").alias("families")).where("families >= 2")


@query("d28_event_histogram", "SELECT event_type, op, count(*) AS n FROM data_events GROUP BY ALL")
def d28_event_histogram(spark, d):
    return star.data_events(spark, d).groupBy("event_type", "op").agg(F.count("*").alias("n"))


@query("d29_samples", """
SELECT run, min(value) AS low, max(value) AS high, count_if(value <> 0)::BIGINT AS nonzero, bool_and(value = 0) AS all_zero FROM data_events GROUP BY run""")
def d29_samples(spark, d):
    return star.data_events(spark, d).groupBy("run").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") != 0).alias("nonzero"), F.bool_and(F.col("value") == 0).alias("all_zero"))


@query("d31_consensus", """
SELECT l_partkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'UNKNOWN' END AS l_returnflag,
  CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'UNKNOWN' END AS l_linestatus FROM lineitem GROUP BY l_partkey""", graph=False)
def d31_consensus(spark, d):
    return rollup.consensus(star.table(spark, d, "lineitem"), ["l_partkey"], ["l_returnflag", "l_linestatus"])


@query("d32_reconcile", """
SELECT l_partkey, l_linestatus, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'EVIDENCE' ELSE 'CONFLICT' END AS status, count(DISTINCT l_returnflag) AS variants, count(DISTINCT l_suppkey) AS providers
FROM lineitem GROUP BY l_partkey, l_linestatus""", graph=False)
def d32_reconcile(spark, d):
    return rollup.reconcile(star.table(spark, d, "lineitem"), ["l_partkey", "l_linestatus"], "l_returnflag", "l_suppkey")


@query("d35_overall", "SELECT arg_min(o_orderpriority, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END) AS overall FROM orders", graph=False)
def d35_overall(spark, d):
    return rollup.overall(star.table(spark, d, "orders"), "o_orderpriority", ["3-MEDIUM", "5-LOW", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED"])


@query("d38_accuracy", """
, e AS (SELECT doc_id FROM labels WHERE quality = 0), a AS (SELECT doc_id FROM documents WHERE contains(text, ' | ') OR contains(text, '!!') OR contains(text, '%%%'))
, j AS (SELECT e.doc_id AS e, a.doc_id AS a FROM e FULL JOIN (SELECT doc_id FROM a WHERE doc_id IN (SELECT doc_id FROM labels)) a ON e.doc_id = a.doc_id)
, n AS (SELECT count_if(e IS NOT NULL AND a IS NOT NULL)::BIGINT AS tp, count_if(e IS NULL)::BIGINT AS fp, count_if(a IS NULL)::BIGINT AS fn FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM n""")
def d38_accuracy(spark, d):
    labels = star.table(spark, d, "labels")
    flagged = star.table(spark, d, "documents").where(classify.any_of(F.col("text"), [" | ", "!!", "%%%"])).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_semi")
    return rollup.accuracy(labels.where("quality = 0"), flagged, ["doc_id"])


@query("d39_digest", """
WITH r AS (SELECT l_suppkey, sha256('{"l_partkey":' || l_partkey || ',"l_quantity":' || l_quantity || ',"l_returnflag":"' || l_returnflag || '"}') AS h FROM lineitem)
, p AS (SELECT l_suppkey, count(*) AS n, sum(('0x' || h[1:8])::BIGINT)::VARCHAR AS p0, sum(('0x' || h[9:16])::BIGINT)::VARCHAR AS p1, sum(('0x' || h[17:24])::BIGINT)::VARCHAR AS p2, sum(('0x' || h[25:32])::BIGINT)::VARCHAR AS p3 FROM r GROUP BY l_suppkey)
SELECT l_suppkey, n, sha256(n || ':' || p0 || ':' || p1 || ':' || p2 || ':' || p3) AS digest FROM p""", graph=False)
def d39_digest(spark, d):
    return rollup.digest(star.table(spark, d, "lineitem"), ["l_suppkey"], ["l_partkey", "l_quantity", "l_returnflag"])


@query("d40_project_to_units", f"""{_REGIONS}
SELECT a.unit AS src_unit, b.unit AS dst_unit, count(*) AS n, sum(weight)::BIGINT AS weight, a.unit = b.unit AS intra FROM all_trades t JOIN member a ON a.id = t.src JOIN member b ON b.id = t.dst GROUP BY ALL""")
def d40_project_to_units(spark, d):
    m = _regions(spark, d)
    j = star.trades(spark, d).join(m.toDF("src", "src_unit"), "src").join(m.toDF("dst", "dst_unit"), "dst")
    return j.groupBy("src_unit", "dst_unit").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).withColumn("intra", F.col("src_unit") == F.col("dst_unit"))


@query("d42_performance", """
, spans AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders), child AS (SELECT l_orderkey, sum(l_extendedprice) AS c FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS inclusive, round(sum(o_totalprice - coalesce(c, 0)), 2) AS exclusive FROM spans LEFT JOIN child ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def d42_performance(spark, d):
    child = star.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("c"))
    j = star.table(spark, d, "orders").join(child, "o_orderkey", "left")
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("inclusive"), F.round(F.sum(F.col("o_totalprice") - F.coalesce("c", F.lit(0.0))), 2).alias("exclusive"))


@query("d43_run_metadata", "SELECT run, count(*) AS n, count(DISTINCT object) AS objects, count(DISTINCT op) AS ops FROM data_events GROUP BY run")
def d43_run_metadata(spark, d):
    return star.data_events(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("object").alias("objects"), F.count_distinct("op").alias("ops"))


@query("e2_last_writer", """
SELECT run, object, writer, event_id AS reader FROM (
  SELECT *, last_value(CASE WHEN op IN ('WRITE', 'READ_WRITE') THEN event_id END IGNORE NULLS) OVER (PARTITION BY run, object ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM data_events)
WHERE op IN ('READ', 'READ_WRITE') AND writer IS NOT NULL""")
def e2_last_writer(spark, d):
    return trace.last_writer(star.data_events(spark, d), ["ts", "event_id"])


@query("e3_numbering", "SELECT event_id, run, (row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1)::BIGINT AS seq FROM data_events")
def e3_numbering(spark, d):
    return trace.numbered(star.data_events(spark, d), ["run"], ["ts", "event_id"]).select("event_id", "run", "seq")


@query("e4_clusters", "SELECT event_id, sum((op = 'WRITE')::INTEGER) OVER (PARTITION BY run ORDER BY ts, event_id)::BIGINT AS cluster FROM data_events")
def e4_clusters(spark, d):
    return trace.clusters(star.data_events(spark, d), ["run"], ["ts", "event_id"], F.col("op") == "WRITE").select("event_id", "cluster")


@query("e5_nesting", """
, steps AS (SELECT run, (row_number() OVER (PARTITION BY run ORDER BY ts, event_id)) AS k FROM data_events)
, rows_ AS (SELECT run, k, CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE -1 END AS step FROM steps)
SELECT run, k, step, CASE WHEN k % 4 IN (1, 0) THEN 1 ELSE 2 END::BIGINT AS depth, CASE WHEN k % 4 = 2 THEN k - 1 ELSE 0 END::BIGINT AS parent FROM rows_""")
def e5_nesting(spark, d):
    rows = trace.numbered(star.data_events(spark, d), ["run"], ["ts", "event_id"], "k").select("run", (F.col("k") + 1).alias("k"))
    rows = rows.withColumn("step", F.when((F.col("k") % 4).isin(1, 2), 1).otherwise(-1))
    return trace.nesting(rows, ["run"], "k").select("run", "k", "step", "depth", F.coalesce("parent", F.lit(0)).alias("parent"))


@query("e6_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':7'), event_id) AS rn FROM events) WHERE rn <= 5", graph=False)
def e6_sample(spark, d):
    return trace.sample(star.table(spark, d, "events"), "event_type", "event_id", 5, seed=7).select("event_type", "event_id")


@query("e10_rankings", """
, s AS (SELECT run, count(*)::DOUBLE AS n, max(value) AS peak FROM data_events GROUP BY run)
, l AS (SELECT 'n' AS measure, n AS value, run FROM s UNION ALL SELECT 'peak', peak, run FROM s)
SELECT measure, rank, run, value FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, run)::INTEGER AS rank FROM l) WHERE rank <= 10""")
def e10_rankings(spark, d):
    s = star.data_events(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return trace.rankings(s, "run", ["n", "peak"], 10)


@query("e12_stability", """
, kept AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS' AND src LIKE 'customer:%' AND hash(1) IS NOT NULL AND md5(id)[1:1] NOT IN ('0', '1'))
, all_ AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS' AND src LIKE 'customer:%')
SELECT a.src AS src, round(count(k.dst) / count(*), 6) AS jaccard FROM all_ a LEFT JOIN kept k ON a.src = k.src AND a.dst = k.dst GROUP BY a.src""")
def e12_stability(spark, d):
    e = star.edges(spark, d).where("kind = 'CALLS' AND src LIKE 'customer:%'")
    kept = e.where(~F.substring(F.md5("id"), 1, 1).isin("0", "1"))
    return diff.similarity(e, kept, "src", "dst")


@query("f2_page", "SELECT id, path FROM nodes ORDER BY path, id LIMIT 50 OFFSET 100")
def f2_page(spark, d):
    return star.nodes(spark, d).select("id", "path").orderBy("path", "id").offset(100).limit(50)


@query("f3_top_k", """
SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::INTEGER AS rank FROM all_trades) WHERE rank <= 3""")
def f3_top_k(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return star.trades(spark, d).withColumn("rank", F.row_number().over(w).cast("int")).where("rank <= 3").select("src", "dst", "weight", "rank")


@query("g1_snapshot_diff", f"""{_SNAPSHOTS}
SELECT coalesce(sa.o_orderkey, sb.o_orderkey) AS o_orderkey, CASE WHEN sa.o_orderkey IS NULL THEN 'ADDED' WHEN sb.o_orderkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
FROM sa FULL JOIN sb ON sa.o_orderkey = sb.o_orderkey WHERE sa.o_orderkey IS NULL OR sb.o_orderkey IS NULL OR sa.o_orderpriority <> sb.o_orderpriority OR sa.o_orderstatus <> sb.o_orderstatus OR sa.o_custkey <> sb.o_custkey""")
def g1_snapshot_diff(spark, d):
    return diff.snapshot_diff(*_snapshots(spark, d), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("g2_expectations", """
, e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A')
, k AS (SELECT p_partkey FROM part WHERE p_size > 5)
SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e.l_partkey, a.l_partkey) AS l_partkey,
  CASE WHEN p_partkey IS NULL THEN 'UNBOUND' WHEN e.l_orderkey IS NULL OR a.l_orderkey IS NULL THEN 'MISMATCH' ELSE 'MATCH' END AS status
FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.l_partkey = a.l_partkey LEFT JOIN k ON p_partkey = coalesce(e.l_partkey, a.l_partkey)""")
def g2_expectations(spark, d):
    i = star.table(spark, d, "lineitem")
    bound = star.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return diff.expectations(i.where("l_returnflag <> 'R'"), i.where("l_returnflag <> 'A'"), bound, ["l_orderkey", "l_partkey"], "l_partkey")


@query("g7_delta_units", f"""{_SNAPSHOTS}
SELECT o_orderkey, unit FROM (
  SELECT coalesce(sa.o_orderkey, sb.o_orderkey) AS o_orderkey, unnest([
    CASE WHEN sa.o_orderkey IS NULL THEN 'SYMBOL_ADDED' END, CASE WHEN sb.o_orderkey IS NULL THEN 'SYMBOL_REMOVED' END,
    CASE WHEN sa.o_orderpriority <> sb.o_orderpriority THEN 'SIGNATURE_CHANGED' END, CASE WHEN sa.o_orderstatus <> sb.o_orderstatus THEN 'CONTROL_CHANGED' END]) AS unit
  FROM sa FULL JOIN sb ON sa.o_orderkey = sb.o_orderkey) WHERE unit IS NOT NULL""")
def g7_delta_units(spark, d):
    return diff.delta_units(*_snapshots(spark, d), "o_orderkey", {"SIGNATURE_CHANGED": "o_orderpriority", "CONTROL_CHANGED": "o_orderstatus"})


@query("g12_dangling", f"""{_SNAPSHOTS}
, n AS (SELECT id FROM nodes WHERE kind <> 'ORDER' OR ordinal IN (SELECT o_orderkey FROM sb))
SELECT 'src' AS reference, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'dst', count(*) FROM edges WHERE dst NOT IN (SELECT id FROM n)""")
def g12_dangling(spark, d):
    kept = _snapshots(spark, d)[1].select(star.node_id("order", "o_orderkey").alias("id"))
    ids = star.nodes(spark, d).where("kind <> 'ORDER'").select("id").unionByName(kept)
    return diff.dangling(star.edges(spark, d), {"src": ids, "dst": ids})


@query("h2_shortest_paths", """
, hops(id, distance, path) AS (
  SELECT 'nation:0', 0, 'nation:0' UNION ALL
  SELECT t.dst, h.distance + 1, h.path || '>' || t.dst FROM hops h JOIN trades t ON t.src = h.id WHERE h.distance < 3 AND NOT contains(h.path || '>', t.dst || '>')
), best AS (SELECT id, min(distance) AS distance FROM hops GROUP BY id)
SELECT id, distance::INTEGER AS distance, min(path) AS path FROM hops JOIN best USING (id, distance) GROUP BY ALL""")
def h2_shortest_paths(spark, d):
    return graph.shortest_paths(star.strong_trades(spark, d), "nation:0", 3)


@query("h6_impact", """
, hops(id, distance) AS (SELECT id, 0 FROM nodes WHERE kind = 'PART' AND starts_with(path, 'parts/ECONOMY/Brand#1') UNION
  SELECT e.src, h.distance + 1 FROM hops h JOIN edges e ON e.dst = h.id AND e.kind = 'CALLS' WHERE h.distance < 2)
SELECT id, min(distance)::INTEGER AS distance FROM hops GROUP BY id""")
def h6_impact(spark, d):
    seeds = star.nodes(spark, d).where("kind = 'PART' AND path LIKE 'parts/ECONOMY/Brand#1%'").select("id")
    return graph.impact(star.links(spark, d), seeds, ["CALLS"], 2)


_REACH = ", reach(src, dst) AS (SELECT src, dst FROM trades UNION SELECT r.src, t.dst FROM reach r JOIN trades t ON t.src = r.dst)"


@query("h8_strong_components", f"""{_REACH}
, n AS (SELECT src AS id FROM trades UNION SELECT dst FROM trades), m AS (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
, c AS (SELECT id, least(id, coalesce(m, id)) AS component FROM n LEFT JOIN m USING (id))
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def h8_strong_components(spark, d):
    return graph.strong_components(star.strong_trades(spark, d))


#: Parts that follow one another in orders, and those of them that lead to larger numbers: graphs that grow with the tables.
_SUCC = """
WITH RECURSIVE succ AS (SELECT 'part:' || p AS src, 'part:' || q AS dst, count(*) AS weight, p < q AS up FROM (
  SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS q FROM lineitem WHERE l_quantity > 42) WHERE q IS NOT NULL AND p <> q GROUP BY ALL)
, far(src, dst) AS (SELECT a.src, b.dst FROM succ a JOIN succ b ON a.dst = b.src AND a.up AND b.up UNION SELECT f.src, g.dst FROM far f JOIN succ g ON g.src = f.dst AND g.up)
"""


def _upward(spark, d):
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return star.successions(spark, d).where(number("src") < number("dst"))


@query("h8_part_components", f"""{_SUCC}
, reach(src, dst) AS (SELECT src, dst FROM succ UNION SELECT r.src, s.dst FROM reach r JOIN succ s ON s.src = r.dst)
, n AS (SELECT src AS id FROM succ UNION SELECT dst FROM succ), m AS (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
, c AS (SELECT id, least(id, coalesce(m, id)) AS component FROM n LEFT JOIN m USING (id))
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c""", graph=False)
def h8_part_components(spark, d):
    return graph.strong_components(star.successions(spark, d))


@query("h9_part_levels", f"""{_SUCC}
, walk(id, level) AS (SELECT DISTINCT src, 0 FROM succ WHERE up AND src NOT IN (SELECT dst FROM succ WHERE up) UNION SELECT g.dst, w.level + 1 FROM walk w JOIN succ g ON g.src = w.id AND g.up)
SELECT id, max(level)::INTEGER AS level FROM walk GROUP BY id""", graph=False)
def h9_part_levels(spark, d):
    return graph.levels(_upward(spark, d))


@query("h11_part_reduction", f"{_SUCC} SELECT src, dst FROM succ WHERE up AND (src, dst) NOT IN (SELECT src, dst FROM far)", graph=False)
def h11_part_reduction(spark, d):
    return graph.reduced(_upward(spark, d))


@query("h12_part_longest", f"""{_SUCC}
, walk(id, length) AS (SELECT src, 0::BIGINT FROM succ WHERE up UNION SELECT dst, 0::BIGINT FROM succ WHERE up UNION SELECT g.dst, w.length + g.weight FROM walk w JOIN succ g ON g.src = w.id AND g.up)
SELECT id, max(length)::BIGINT AS length FROM walk GROUP BY id""", graph=False)
def h12_part_longest(spark, d):
    return graph.longest_paths(_upward(spark, d))


@query("h10_cone", f"{_REACH} SELECT src AS id FROM reach WHERE dst = 'nation:5' UNION SELECT 'nation:5'")
def h10_cone(spark, d):
    e = star.strong_trades(spark, d)
    seeds = star.nodes(spark, d).where("id = 'nation:5'").select("id")
    return graph.bfs(e, seeds, None, "in").select("id")


_DAG = ", dag AS (SELECT src, dst, weight FROM trades WHERE src < dst)"


def _dag(spark, d):
    return star.strong_trades(spark, d).where("src < dst")


@query("h9_levels", f"""{_DAG}
, walk(id, level) AS (SELECT DISTINCT src, 0 FROM dag WHERE src NOT IN (SELECT dst FROM dag) UNION SELECT g.dst, w.level + 1 FROM walk w JOIN dag g ON g.src = w.id)
SELECT id, max(level)::INTEGER AS level FROM walk GROUP BY id""")
def h9_levels(spark, d):
    return graph.levels(_dag(spark, d))


@query("h11_reduction", f"""{_DAG}
, far(src, dst) AS (SELECT a.src, b.dst FROM dag a JOIN dag b ON a.dst = b.src UNION SELECT f.src, g.dst FROM far f JOIN dag g ON g.src = f.dst)
SELECT src, dst FROM dag WHERE (src, dst) NOT IN (SELECT src, dst FROM far)""")
def h11_reduction(spark, d):
    return graph.reduced(_dag(spark, d))


@query("h12_longest_paths", f"""{_DAG}
, walk(id, length) AS (SELECT DISTINCT src, 0::BIGINT FROM dag UNION SELECT DISTINCT dst, 0::BIGINT FROM dag UNION SELECT g.dst, w.length + g.weight FROM walk w JOIN dag g ON g.src = w.id)
SELECT id, max(length)::BIGINT AS length FROM walk GROUP BY id""")
def h12_longest_paths(spark, d):
    return graph.longest_paths(_dag(spark, d))


@query("h13_components", """
, e AS (SELECT src, dst FROM edges WHERE kind = 'CONTAINS' UNION SELECT dst, src FROM edges WHERE kind = 'CONTAINS')
, r(id, root) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id WHERE r.root LIKE 'customer:1%' OR r.root LIKE 'customer:0%')
SELECT id, min(root) AS component FROM r GROUP BY id""")
def h13_components(spark, d):
    return graph.components(star.edges(spark, d).where("kind = 'CONTAINS'"))


@query("h14_chains", f"""{_DAG}
, w(e, path, n) AS (SELECT 'nation:0', 'nation:0', 1 UNION ALL SELECT g.dst, w.path || '>' || g.dst, w.n + 1 FROM w JOIN dag g ON g.src = w.e WHERE w.n < 5)
SELECT path, n::BIGINT AS nodes FROM w WHERE n > 1 AND e NOT IN (SELECT src FROM dag)""")
def h14_chains(spark, d):
    seeds = star.nodes(spark, d).where("id = 'nation:0'").select("id")
    return graph.simple_chains(_dag(spark, d), seeds, 5)


@query("h15_cycles", """
, w(root, e, path, n) AS (SELECT src, dst, [src, dst], 2 FROM trades WHERE dst > src UNION ALL
  SELECT w.root, t.dst, list_append(w.path, t.dst), w.n + 1 FROM w JOIN trades t ON t.src = w.e WHERE w.n < 4 AND t.dst > w.root AND NOT list_contains(w.path, t.dst))
SELECT array_to_string(path, '>') AS path, n::BIGINT AS nodes FROM w WHERE EXISTS (SELECT 1 FROM trades t WHERE t.src = w.e AND t.dst = w.root)""")
def h15_cycles(spark, d):
    return graph.cycles(star.strong_trades(spark, d), 4)


@query("h16_subtree", """
, t(id, depth) AS (SELECT 'region:1', 0 UNION ALL SELECT e.dst, t.depth + 1 FROM t JOIN edges e ON e.src = t.id AND e.kind = 'CONTAINS')
SELECT id, depth::INTEGER AS depth FROM t""")
def h16_subtree(spark, d):
    seeds = star.nodes(spark, d).where("id = 'region:1'").select("id")
    return graph.bfs(star.edges(spark, d).where("kind = 'CONTAINS'"), seeds, None, "out").withColumnRenamed("distance", "depth")


@query("j1_search", """
, q AS (SELECT id, 0 AS tier, 'name' AS match FROM nodes WHERE name = 'red ring' UNION ALL SELECT id, 1, 'path' FROM nodes WHERE path = 'red ring'
  UNION ALL SELECT id, 2, 'text' FROM nodes WHERE list_has_all(regexp_split_to_array(lower(name || ' ' || path), '[^a-z0-9_]+'), ['red', 'ring'])
  UNION ALL SELECT id, 3, 'substring' FROM nodes WHERE contains(lower(name), 'red ring'))
SELECT id, arg_min(match, tier) AS match, min(tier)::INTEGER AS tier FROM q GROUP BY id ORDER BY tier, id LIMIT 100""")
def j1_search(spark, d):
    return search.search(star.nodes(spark, d), "red ring", 100)


@query("j2_full_text", "SELECT id, 2::BIGINT AS hits FROM nodes WHERE list_has_all(regexp_split_to_array(lower(name || ' ' || path), '[^a-z0-9_]+'), ['economy', 'small'])")
def j2_full_text(spark, d):
    return search.full_text(star.nodes(spark, d), "economy small")


@query("j3_substring", "SELECT id FROM nodes WHERE contains(lower(name), 'tion_1')")
def j3_substring(spark, d):
    return search.substring(star.nodes(spark, d), "TION_1").select("id")


def _context(spark, d):
    """Parts' types as tokens between suppliers' nations and customers' nations."""
    e = star.trades(spark, d).select("src", "dst", F.concat(F.lit("t"), (F.col("weight") % 7).cast("string")).alias("token"), F.when(F.col("weight") % 2 == 0, "WRITE").otherwise("READ").alias("access"), F.when(F.col("weight") % 5 == 0, "UNKNOWN").otherwise("EXACT").alias("resolution"))
    blocks = star.nodes(spark, d).where("kind = 'NATION'").select(F.col("id").alias("block"), "ordinal")
    ports = blocks.select("block", F.explode(F.array(*[F.lit(f"t{i}") for i in range(7)])).alias("token"), F.explode(F.array(F.lit("in"))).alias("direction"), F.when(F.col("ordinal") % 2 == 0, "RESOLVED").otherwise("INFERRED").alias("truth"))
    ports = ports.unionByName(ports.withColumn("direction", F.lit("out")))
    order = star.strong_trades(spark, d).select(F.col("src").alias("before"), F.col("dst").alias("after"))
    resources = star.nodes(spark, d).where("kind = 'CUSTOMER'").select(F.col("id").alias("block"), F.col("language").alias("resource"))
    environment = resources.where("resource <> 'MACHINERY'").select("resource").distinct()
    return {"edges": e, "ports": ports, "order": order, "resources": resources, "environment": environment}


_CONTEXT = """
, e AS (SELECT src, dst, 't' || (weight % 7) AS token, CASE WHEN weight % 2 = 0 THEN 'WRITE' ELSE 'READ' END AS access, CASE WHEN weight % 5 = 0 THEN 'UNKNOWN' ELSE 'EXACT' END AS resolution FROM all_trades)
, p AS (SELECT id AS block, 't' || unnest(range(7)) AS token, CASE WHEN ordinal % 2 = 0 THEN 'RESOLVED' ELSE 'INFERRED' END AS truth FROM nodes WHERE kind = 'NATION')
, o AS (SELECT src AS a, dst AS b FROM trades UNION SELECT dst, src FROM trades)
, w AS (SELECT DISTINCT token, src AS x FROM e WHERE access = 'WRITE'), r AS (SELECT DISTINCT token, src AS x FROM e WHERE access = 'READ')
, findings AS (
  SELECT 'P001' AS rule, CASE WHEN truth <> 'INFERRED' THEN 'ERROR' ELSE 'WARNING' END AS severity, CASE WHEN truth <> 'INFERRED' THEN 'VIOLATION' ELSE 'UNKNOWN' END AS status, block AS subject, token FROM p WHERE (block, token) NOT IN (SELECT dst, token FROM e)
  UNION ALL SELECT 'P002', 'INFO', 'VIOLATION', block, token FROM p WHERE (block, token) NOT IN (SELECT src, token FROM e)
  UNION ALL SELECT 'D001', 'ERROR', 'VIOLATION', dst, token FROM e GROUP BY dst, token HAVING count(DISTINCT src) > 1
  UNION ALL SELECT 'S001', 'ERROR', 'VIOLATION', u.x || '|' || v.x, u.token FROM w u JOIN w v ON u.token = v.token AND u.x < v.x WHERE (u.x, v.x) NOT IN (SELECT a, b FROM o)
  UNION ALL SELECT 'S002', 'WARNING', 'VIOLATION', u.x || '|' || v.x, u.token FROM w u JOIN r v ON u.token = v.token AND u.x <> v.x WHERE (u.x, v.x) NOT IN (SELECT a, b FROM o)
  UNION ALL SELECT 'R001', 'ERROR', 'VIOLATION', 'customer:' || c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT 'U001', 'INFO', 'UNKNOWN', src, count(*)::VARCHAR FROM e WHERE resolution <> 'EXACT' GROUP BY src
)"""


@query("k21_all_rules", f"{_CONTEXT} SELECT * FROM findings")
def k21_all_rules(spark, d):
    return rules.run(_context(spark, d))


@query("d36_finding_summary", f"{_CONTEXT} SELECT rule, severity, status, count(*) AS n FROM findings GROUP BY ALL")
def d36_finding_summary(spark, d):
    return rules.summary(rules.run(_context(spark, d)))


for _name, _rule in (("k1_p001", "P001"), ("k2_p002", "P002"), ("k5_d001", "D001"), ("k8_s001", "S001"), ("k9_s002", "S002"), ("k14_r001", "R001"), ("k17_u001", "U001")):
    query(_name, f"{_CONTEXT} SELECT * FROM findings WHERE rule = '{_rule}'")(lambda spark, d, r=_rule: rules.RULES[r](_context(spark, d), "COMPLETE"))
