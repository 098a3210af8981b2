"""Lookups, joins and set-oriented passes over nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(keys: DataFrame, rows: DataFrame, on: Sequence[str], id_col: str = "id") -> DataFrame:
    """Each key with status NOT_FOUND, FOUND or AMBIGUOUS, the id if it is the only one, and the count."""
    by = rows.groupBy(*on).agg(F.count(id_col).alias("n"), F.min(id_col).alias("one"))
    joined = keys.join(by, list(on), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "FOUND").otherwise("AMBIGUOUS")
    return joined.select(*on, status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("id"), "n")


def within(path: Column, prefix: str) -> Column:
    """Path equality or containment; a/b is not within a/bc."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; partitions are by the keys, so this scales with them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def adjacency(nodes: DataFrame, edges: DataFrame, direction: str = "both", kinds: Sequence[str] | None = None) -> DataFrame:
    """node, direction, kind, other, other_kind, other_name for each end of the edges."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    other = nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("name").alias("other_name"))
    ends = {"out": ("src", "dst"), "in": ("dst", "src")}
    parts = [edges.select(F.col(a).alias("node"), F.lit(d).alias("direction"), "kind", F.col(b).alias("other")) for d, (a, b) in ends.items() if direction in (d, "both")]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.join(other, "other").select("node", "direction", "kind", "other", "other_kind", "other_name")


def without_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with neither end among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")


def orphans(receipts: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Receipts whose fact is gone."""
    return receipts.join(facts.select(*keys), list(keys), "left_anti")


def unique_definitions(rows: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Keys that have exactly one definition, and its id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_col).alias(id_col)).where("n = 1").drop("n")


def cascade(refs: DataFrame, tiers: Sequence[tuple[str, float, DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """Each reference resolved by the first tier that has a target.

    A tier is (label, confidence, targets, join columns); targets hold the join columns and
    `target`. Tiers with several targets for a reference stop it as ambiguous.
    """
    labels, confidence, target, stopped = [], [], [], []
    out = refs
    for i, (label, sure, targets, on) in enumerate(tiers):
        found = targets.groupBy(*on).agg(F.count("*").alias(f"n{i}"), F.min("target").alias(f"t{i}"))
        out = out.join(found, list(on), "left")
        n = F.coalesce(F.col(f"n{i}"), F.lit(0))
        labels.append(F.when(n == 1, label).when(n > 1, "ambiguous"))
        confidence.append(F.when(n == 1, F.lit(sure)).when(n > 1, F.lit(0.0)))
        target.append(F.when(n == 1, F.col(f"t{i}")).when(n > 1, F.lit("")))
        stopped.append(n)
    picked = F.nullif(F.coalesce(*target, F.lit("")), F.lit(""))
    return out.select(key, F.coalesce(*labels, F.lit("unresolved")).alias("tier"), F.coalesce(*confidence, F.lit(0.0)).alias("confidence"), picked.alias("target"))


def _span_cells(points: DataFrame, spans: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(spans, points) with the cells c that they have: a span is in a point's path and holds it if and only if they
    share exactly one.

    A span (start to end, whole numbers from 0 on) is cut into aligned intervals of powers of two; a point has the one
    interval of each size that holds it. So work is by point and span times the number of sizes, however many spans
    a path has. A cut table is many times larger than Spark's guess from the columns it is made of, so joins of it
    are to be merged, never broadcast.
    """
    widest = spans.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 1
    sizes = F.sequence(F.lit(0), F.lit(int(widest).bit_length()))
    low = lambda k: F.ceil(F.col("start") / F.pow(F.lit(2.0), k)).cast("long")
    high = lambda k: F.floor((F.col("end") + 1) / F.pow(F.lit(2.0), k)).cast("long")
    cell = lambda k, i: F.struct(k.alias("size"), i.alias("cell"))
    cut = F.flatten(F.transform(sizes, lambda k: F.array(
        F.when((low(k) < high(k)) & (low(k) % 2 == 1), cell(k, low(k))), F.when((low(k) < high(k)) & (high(k) % 2 == 1), cell(k, high(k) - 1)),
    )))
    parts = spans.withColumn("c", F.explode(F.array_compact(cut)))
    point = F.col(at).cast("long")
    return parts, points.withColumn("c", F.explode(F.transform(sizes, lambda k: cell(k, F.floor(point / F.pow(F.lit(2.0), k)).cast("long")))))


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Each point with the innermost span that holds it: the largest start, then the largest id.

    points: path, key, at; spans: path, id, start, end (whole numbers from 0 on). Of the spans cut to one interval only
    the best stays.
    """
    parts, asked = _span_cells(points.select("path", key, at), spans.select("path", "id", "start", "end"), at)
    best = parts.groupBy("path", "c").agg(F.max(F.struct("start", "id")).alias("best"))
    found = asked.select("path", key, "c").join(best.hint("merge"), ["path", "c"], "left")
    return found.groupBy(key).agg(F.max("best").alias("b")).select(key, F.col("b.id").alias("span_id"))


def covered(points: DataFrame, spans: DataFrame, at: str) -> DataFrame:
    """Points (path, at, ...) beside each span (path, id, start, end) that holds them, each pair once."""
    parts, asked = _span_cells(points, spans.select("path", "id", "start", "end"), at)
    return asked.join(parts.select("path", "id", "c").hint("merge"), ["path", "c"]).drop("c")


def planes(static: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Static against observed relations: both, static_only or observed_only."""
    a, b = static.select(*on).distinct().withColumn("s", F.lit(1)), observed.select(*on).distinct().withColumn("o", F.lit(1))
    plane = F.when(F.col("s").isNull(), "observed_only").when(F.col("o").isNull(), "static_only").otherwise("both")
    return a.join(b, list(on), "full_outer").select(*on, plane.alias("plane"))


def dealt_pairs(a: DataFrame, b: DataFrame, key: str, most: int = 1_000) -> DataFrame:
    """a joined to b on the key, where one key may have many rows on both sides: its rows of a are dealt over pieces of
    at most about `most`, and its rows of b stand beside each piece. No pair is lost or made twice."""
    pieces = a.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("pieces_"))
    dealt = a.join(pieces, key).withColumn("piece_", F.pmod(F.xxhash64(*a.columns), F.col("pieces_")).cast("int")).drop("pieces_")
    copied = b.join(pieces, key).withColumn("piece_", F.explode(F.sequence(F.lit(0), F.col("pieces_") - 1))).drop("pieces_")
    return dealt.join(copied, [key, "piece_"]).drop("piece_")


def sharing_pairs(rows: DataFrame, id_col: str, token: str, piece: int = 1_000) -> DataFrame:
    """a < b, shared: unordered pairs that share tokens, and how many; the holders of a hot token are dealt over pieces."""
    held = rows.select(F.col(id_col).alias("id"), F.col(token).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    pairs = dealt_pairs(held.toDF("a", "t"), held.toDF("b", "t"), "t", piece).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
