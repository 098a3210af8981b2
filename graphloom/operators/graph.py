"""Graph operators as loops of joins; every round is written to the shared folder.

Edges have src and dst (strings). Frontiers and visited sets stay distributed; the driver only
learns how many rows a round added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import settled


def _arcs(edges: DataFrame, direction: str) -> DataFrame:
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


#: Walks of at most so many steps join their front to the edges as they are; longer ones first write the arcs.
FEW_STEPS = 3


def near(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """id, distance of all nodes within a few steps of the seeds (id).

    Nothing is written but the fronts: each step joins the front to the edges by src and by dst, so filters and
    columns reach the scans, edges need not be distinct, and a small front is broadcast.
    """
    seen = front = settled(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "front")
    for step in range(1, depth + 1):
        last = front.select("id")
        ways = [("src", "dst")] * (direction in ("out", "both")) + [("dst", "src")] * (direction in ("in", "both"))
        found = [edges.join(last.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id")) for a, b in ways]
        found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        front = settled(found.distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "out") -> DataFrame:
    """id, distance of all nodes within `depth` steps of the seeds (id); without depth: all reachable ones."""
    if depth is not None and depth <= FEW_STEPS:
        return near(edges, seeds, depth, direction)
    arcs = settled(_arcs(edges, direction), "arcs")
    front = seeds.select("id").distinct()
    seen = settled(front.withColumn("distance", F.lit(0)), "seen")
    step = 0
    while depth is None or step < depth:
        step += 1
        last = seen.where(F.col("distance") == step - 1).select(F.col("id").alias("src"))
        found = arcs.join(last, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        found = settled(found.withColumn("distance", F.lit(step)), "front")
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        if step % 8 == 0:
            seen = settled(seen, "seen")
    return seen


def shortest_paths(edges: DataFrame, source: str, depth: int) -> DataFrame:
    """id, distance, path: the least (by text) of the shortest paths from the source, as ids joined by '>'."""
    arcs = settled(_arcs(edges, "out"), "arcs")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(source, 0, source)], "id string, distance int, path string")
    for step in range(1, depth + 1):
        last = seen.where(F.col("distance") == step - 1).select(F.col("id").alias("src"), "path")
        found = arcs.join(last, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path"))
        found = settled(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance"), "path"), "paths")
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
    return seen


def _trimmed(arcs: DataFrame) -> DataFrame:
    """The arcs between nodes that have arcs both in and out, again and again: what is left may hold cycles."""
    n = arcs.count()
    while n:
        heads, tails = arcs.select(F.col("src").alias("id")).distinct(), arcs.select(F.col("dst").alias("id")).distinct()
        live = heads.join(tails, "id")
        arcs = settled(arcs.join(live.toDF("src"), "src", "left_semi").join(live.toDF("dst"), "dst", "left_semi"), "arcs")
        m = arcs.count()
        if m == n:
            break
        n = m
    return arcs


def _coloured(arcs: DataFrame) -> DataFrame:
    """id, colour: the least node that reaches each node of the arcs."""
    colour = settled(arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")), "colours")
    while True:
        via = arcs.join(colour.toDF("src", "via"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("via").alias("via"))
        new = settled(colour.join(via, "id", "left").select("id", F.least("colour", "via").alias("colour"), (F.col("via") < F.col("colour")).alias("moved")), "colours")
        colour = new.select("id", "colour")
        if new.where("moved").isEmpty():
            return colour


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (least member), size: nodes that reach each other, and single nodes.

    Nodes without arcs in or out are trimmed, the others coloured by the least node that reaches
    them; what reaches a colour's own node inside the colour is a component. Components are taken
    out and the rest is treated likewise. Work is by node and arc, never by pair of nodes.
    """
    every = settled(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "nodes")
    arcs = settled(edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    found = None
    while True:
        arcs = _trimmed(arcs)
        if arcs.isEmpty():
            break
        colour = _coloured(arcs)
        inside = arcs.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").where("c = d").select("src", "dst", "c")
        inside = settled(inside, "inside")
        front = seen = settled(colour.where("id = colour").select("id", F.col("colour").alias("component")), "front")
        while True:
            back = inside.join(front.select(F.col("id").alias("dst"), F.col("component").alias("c")), ["dst", "c"]).select(F.col("src").alias("id"), F.col("c").alias("component")).distinct()
            front = settled(back.join(seen.select("id"), "id", "left_anti"), "front")
            if front.isEmpty():
                break
            seen = settled(seen.unionByName(front), "seen")
        found = seen if found is None else found.unionByName(seen)
        left = arcs.join(seen.select(F.col("id").alias("src")), "src", "left_anti").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        arcs = settled(left, "arcs")
    named = every.withColumn("component", F.col("id")) if found is None else every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")


def levels(edges: DataFrame) -> DataFrame:
    """id, level: rounds in which nodes lose their last open predecessor; level is null on and behind cycles."""
    arcs = settled(edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    nodes = settled(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "nodes")
    done = None
    level, open_arcs, left = 0, arcs, nodes
    while True:
        free = settled(left.join(open_arcs.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = settled(left.join(free.select("id"), "id", "left_anti"), "left")
        open_arcs = settled(open_arcs.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "arcs")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def longest_paths(edges: DataFrame) -> DataFrame:
    """id, length: the heaviest path that ends at each node of an acyclic graph (src, dst, weight); a cycle is an error."""
    arcs = settled(edges.select("src", "dst", "weight"), "arcs")
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    best = settled(nodes.withColumn("length", F.lit(0).cast("long")), "lengths")
    for _ in range(best.count() + 1):
        via = arcs.join(best.select(F.col("id").alias("src"), "length"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("length") + F.col("weight")).alias("via"))
        new = settled(best.join(via, "id", "left").select("id", F.greatest("length", F.coalesce("via", F.lit(0))).alias("length"), (F.col("via") > F.col("length")).alias("moved")), "lengths")
        best = new.select("id", "length")
        if new.where("moved").isEmpty():
            return best
    raise ValueError("the graph has a cycle of positive weight: no path is longest")


def reduced(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path replaces; a cycle is an error.

    An edge to the next level can have no detour. For the sources of other edges, walks go on only
    below the highest level that such an edge of theirs ends at.
    """
    arcs = settled(edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    level = settled(levels(arcs), "levels")
    if not level.where("level IS NULL").isEmpty():
        raise ValueError("the graph has a cycle: it has no unique reduction")
    high = settled(arcs.join(level.toDF("src", "a"), "src").join(level.toDF("dst", "b"), "dst"), "arcs")
    far = settled(high.where("b > a + 1"), "far")
    limit = far.groupBy(F.col("src").alias("root")).agg(F.max("b").alias("top"))
    step = high.select("src", "dst", "b")
    front = step.join(limit.withColumnRenamed("root", "src"), "src").where("b < top").select(F.col("src").alias("root"), F.col("dst").alias("at"), "top")
    front = seen = settled(front, "front")
    hit = None
    while not front.isEmpty():
        moved = front.join(step.select(F.col("src").alias("at"), F.col("dst").alias("next"), "b"), "at").where("b <= top")
        moved = settled(moved.select("root", F.col("next").alias("at"), "top", "b").distinct(), "moved")
        again = moved.select(F.col("root").alias("src"), F.col("at").alias("dst"))
        hit = again if hit is None else hit.unionByName(again)
        front = settled(moved.where("b < top").select("root", "at", "top").join(seen.select("root", "at"), ["root", "at"], "left_anti"), "front")
        seen = settled(seen.unionByName(front), "seen")
    return arcs if hit is None else arcs.join(hit.distinct(), ["src", "dst"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """id, component: connected components by least member, by label rounds that also jump along labels."""
    arcs = settled(_arcs(edges, "both"), "arcs")
    label = settled(arcs.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        near = arcs.join(label.toDF("dst", "near"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("near").alias("near"))
        new = label.join(near, "id").select("id", F.least("label", "near").alias("label"))
        jump = new.join(new.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.least("label", "next").alias("label"))
        new = settled(jump, "labels")
        if new.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        label = new


def chain_walks(edges: DataFrame, seeds: DataFrame, most: int = 5) -> DataFrame:
    """path (array of nodes): simple paths from the seeds that end at a sink within `most` nodes.

    A walk goes on only to nodes from which a sink is near enough, so hardly any is written that ends nowhere. Short
    node keys (numbers) keep the walks small.
    """
    arcs = settled(edges.select("src", "dst").distinct(), "arcs")
    sinks = arcs.select(F.col("dst").alias("id")).distinct().join(arcs.select(F.col("src").alias("id")), "id", "left_anti")
    room = front = settled(sinks.withColumn("hops", F.lit(0)), "room")
    for step in range(1, most - 1):
        back = arcs.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        front = settled(back.join(room.select("id"), "id", "left_anti").withColumn("hops", F.lit(step)), "room")
        room = room.unionByName(front)
    arcs = settled(arcs.join(room.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "hops"), "arcs")
    now = seeds.select(F.col("id").alias("end"), F.array("id").alias("path"))
    found = None
    for k in range(1, most):
        step = now.join(arcs.where(F.col("hops") <= most - 1 - k), now["end"] == arcs["src"]).where(~F.array_contains("path", F.col("dst")))
        step = settled(step.select(F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), "hops"), "chains")
        ended, now = step.where("hops = 0").select("path"), step.where("hops > 0").select("end", "path")
        found = ended if found is None else found.unionByName(ended)
    return found


def simple_chains(edges: DataFrame, seeds: DataFrame, most: int = 5) -> DataFrame:
    """path, nodes: simple paths from the seeds that end at a sink within `most` nodes."""
    return chain_walks(edges, seeds, most).select(F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("nodes"))


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """path, nodes: elementary cycles of at most `most` nodes, each once, from its least node on."""
    arcs = settled(edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    now = arcs.where("dst > src").select(F.col("src").alias("root"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    found = None
    for size in range(2, most + 1):
        closed = now.join(arcs, (now["end"] == arcs["src"]) & (now["root"] == arcs["dst"]), "left_semi").select(F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("nodes"))
        found = closed if found is None else found.unionByName(closed)
        if size < most:
            step = now.join(arcs, now["end"] == arcs["src"]).where((F.col("dst") > F.col("root")) & ~F.array_contains("path", F.col("dst")))
            now = settled(step.select("root", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path")), "cycles")
    return found


def _rooted_distances(arcs: DataFrame, most: int, name: str) -> DataFrame:
    """root, node, name: hops from each root to nodes greater than it, through such nodes only, up to `most`."""
    front = settled(arcs.where("dst > src").select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias(name)), "hops")
    seen = front
    for step in range(2, most + 1):
        found = front.join(arcs.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").where("next > root").select("root", F.col("next").alias("node")).distinct()
        front = settled(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn(name, F.lit(step)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return settled(seen, "hops")


def long_cycles(edges: DataFrame, most: int = 12) -> DataFrame:
    """path, nodes: elementary cycles of 2 to `most` nodes, each once, from its least node on.

    Only arcs inside strong components count. For each root (the least node of a cycle) nodes are kept whose
    hops from and back to the root leave room for a cycle; walks from the root and walks to it, each of half the
    length at most and within these, meet in the middle. A cycle of n nodes is cut after its first (n + 1) / 2
    arcs, so it is made once.
    """
    arcs = settled(edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    comp = settled(strong_components(arcs).where("size > 1").select("id", "component"), "components")
    arcs = settled(arcs.join(comp.toDF("src", "c"), "src").join(comp.toDF("dst", "d"), "dst").where("c = d").select("src", "dst"), "arcs")
    back_arcs = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    room = _rooted_distances(arcs, most - 1, "ahead").join(_rooted_distances(back_arcs, most - 1, "back"), ["root", "node"])
    room = settled(room.where(F.col("ahead") + F.col("back") <= most), "room")

    def walks(steps: DataFrame, length: int, left: str) -> list[DataFrame]:
        """Simple walks of 1, 2, ... arcs from the roots; `left` hops at least are still to go."""
        fits = room.select("root", F.col("node").alias("end"), left)
        now = settled(steps.select(F.col("src").alias("root"), F.col("dst").alias("end")).join(fits, ["root", "end"]).select("root", "end", F.array("end").alias("path")), "walks")
        out = [now]
        for k in range(2, length + 1):
            ahead = now.join(steps.select(F.col("src").alias("end"), F.col("dst").alias("next")), "end").where((F.col("next") > F.col("root")) & ~F.array_contains("path", F.col("next")))
            ahead = ahead.select("root", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path")).join(fits, ["root", "end"]).where(F.col(left) <= most - k)
            now = settled(ahead.select("root", "end", "path"), "walks")
            out.append(now)
        return out

    half = (most + 1) // 2
    out_, in_ = walks(arcs, half, "back"), walks(back_arcs, most - half, "ahead")
    found = None
    for n in range(2, most + 1):
        a, b = out_[(n + 1) // 2 - 1], in_[n // 2 - 1].withColumnRenamed("path", "tail")
        both = a.join(b, ["root", "end"])
        # the middle node ends both walks; nothing else may be on both
        inner = F.slice("tail", 1, F.greatest(F.size("tail") - 1, F.lit(0)))
        both = both.where(~F.arrays_overlap("path", inner)).select(F.array_join(F.concat(F.array("root"), "path", F.reverse(inner)), ">").alias("path"), F.lit(n).cast("long").alias("nodes"))
        found = both if found is None else found.unionByName(both)
    return found


def topology_of(edges: DataFrame, nodes: DataFrame, root: DataFrame, depth: int, relations: Sequence[str], direction: str = "both") -> DataFrame:
    """part (node, edge or boundary), id, kind, src, dst, distance: what stands around the root (id) within `depth` steps.

    Steps take edges of all kinds. Edges of the relations asked for are listed where both ends were reached;
    where only one was, they are the boundary. distance is that of the nearer end.
    """
    seen = settled(near(edges, root, depth, direction), "around")
    none = F.lit(None).cast("string")
    told = nodes.join(seen, "id").select(F.lit("node").alias("part"), "id", "kind", none.alias("src"), none.alias("dst"), "distance")
    of = lambda end, name: seen.select(F.col("id").alias(end), F.col("distance").alias(name))
    asked = edges.where(F.col("kind").isin(*relations)).join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left").where("a IS NOT NULL OR b IS NOT NULL")
    part = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "edge").otherwise("boundary")
    return told.unionByName(asked.select(part.alias("part"), F.concat_ws(":", F.lit("edge"), "kind", "src", "dst").alias("id"), "kind", "src", "dst", F.least("a", "b").alias("distance")))


def path_verdicts(edges: DataFrame, pairs: DataFrame, hops: int, open_sources: DataFrame, complete: bool = False) -> DataFrame:
    """source, target, verdict, hops of each pair: FOUND with the fewest hops; PARTIAL where a node that was reached has
    edges to unknown targets (open_sources: id); else NOT_FOUND, but only if the edges are complete, and UNKNOWN if
    not: absence within a bound is no proof.

    All sources walk at once; a row of a front is a source and a node.
    """
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    seen = front = settled(pairs.select("source", F.col("source").alias("node")).distinct().withColumn("hops", F.lit(0)), "front")
    for k in range(1, hops + 1):
        found = front.select("source", "node").join(steps, "node").select("source", F.col("next").alias("node")).distinct()
        front = settled(found.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    seen = settled(seen, "walked")
    gaps = seen.join(open_sources.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("source").distinct().withColumn("gap", F.lit(True))
    j = pairs.select("source", "target").distinct().join(seen.withColumnRenamed("node", "target"), ["source", "target"], "left").join(gaps, "source", "left")
    verdict = F.when(F.col("hops").isNotNull(), "FOUND").when(F.col("gap"), "PARTIAL").otherwise("NOT_FOUND" if complete else "UNKNOWN")
    return j.select("source", "target", verdict.alias("verdict"), "hops")


def impact(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str], depth: int) -> DataFrame:
    """id, distance of what depends on the seeds: reverse steps along the kinds."""
    return bfs(edges.where(F.col("kind").isin(*kinds)), seeds, depth, "in")


def nearest(reached: DataFrame, budget: int) -> DataFrame:
    """The `budget` nearest nodes (id, distance), ties by id."""
    return reached.orderBy("distance", "id").limit(budget)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both ends of which are among the nodes (id, distance), with the ends' distances."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("distance").alias("src_distance")), nodes.select(F.col("id").alias("dst"), F.col("distance").alias("dst_distance"))
    return edges.join(a, "src").join(b, "dst")


def chains_to(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, distance, chain: what depends on the seeds, and by which chain of ids down to one (the least by text)."""
    arcs = settled(edges.select("src", "dst").distinct(), "arcs")
    seen = settled(seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), F.col("id").alias("chain")), "chains")
    for step in range(1, depth + 1):
        last = seen.where(F.col("distance") == step - 1).select(F.col("id").alias("dst"), "chain")
        found = arcs.join(last, "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.concat_ws(">", "src", "chain")).alias("chain"))
        found = settled(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance"), "chain"), "chains")
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
    return seen
