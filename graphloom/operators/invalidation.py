"""What a change of files makes stale, over several relations at once, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import settled


def resolved(file: Column, target: Column) -> Column:
    """The path that a target names from a file's folder, with . and .. taken away."""
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    parts = F.split(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", folder, target)), "/")
    # .. above the top stays, as it names no file of the tree
    step = lambda done, p: (
        F.when((p == "") | (p == "."), done)
        .when((p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def changed_definitions(before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """name, qname of the definitions of the files (file) that one side has and the other has not.

    before, after: file, name, qname and whatever else a definition is known by.
    """
    keys = [c for c in before.columns if c != "file"]
    side = lambda rows, n: rows.join(files, "file", "left_semi").select(*keys, F.lit(n).alias("side_")).distinct()
    both = side(before, 1).unionByName(side(after, 2)).groupBy(*keys).agg(F.sum("side_").alias("sides_"))
    return both.where("sides_ < 3").select("name", "qname").distinct()


def including(includes: DataFrame, seeds: DataFrame) -> DataFrame:
    """file, target, distance: files that include the seeds (file), or a file that does, and by which target.

    includes: file, target. A target is the file of its resolved path or any file of its base name. The
    loop joins only the files found last; a file that is no seed gets each target of its that was reached.
    """
    keyed = includes.select("file", "target", F.explode(F.array(F.concat(F.lit("p:"), resolved(F.col("file"), F.col("target"))), F.concat(F.lit("b:"), base_name(F.col("target"))))).alias("key"))
    arcs = settled(keyed.distinct(), "includes")
    keys = lambda files: files.select(F.explode(F.array(F.concat(F.lit("p:"), F.col("file")), F.concat(F.lit("b:"), base_name(F.col("file"))))).alias("key")).distinct()
    front = seen = settled(seeds.select("file").distinct(), "front")
    out, step = None, 0
    while True:
        step += 1
        hit = settled(arcs.join(keys(front), "key").select("file", "target").distinct().withColumn("distance", F.lit(step)), "reached")
        out = hit if out is None else out.unionByName(hit)
        front = settled(hit.select("file").distinct().join(seen, "file", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen, out = settled(seen, "seen"), settled(out, "reached")
    return out.groupBy("file", "target").agg(F.min("distance").alias("distance")).join(seeds, "file", "left_anti")


def invalidated(seeds: DataFrame, before: DataFrame, after: DataFrame, includes: DataFrame, calls: DataFrame, pending: DataFrame, imports: DataFrame) -> DataFrame:
    """file, reasons: the files that are stale, and all reasons why, sorted and joined by commas.

    seeds: file, semantic (did what it says change, or only its input); before, after: the definitions of
    files; includes: file, target; calls: file, callee, candidates (array); pending: file, src, dst;
    imports: file, module. Includes of semantic seeds are followed all the way. Users of definitions that
    changed are one step away: calls by name or candidate, symbolic edges by either end, imports by
    qualified name.
    """
    semantic = settled(seeds.where("semantic").select("file").distinct(), "semantic")
    changed = settled(changed_definitions(before, after, semantic), "changed")
    names, qnames = changed.select("name").distinct(), changed.select("qname").distinct()
    either = names.toDF("value").unionByName(qnames.toDF("value")).distinct()
    rows = [seeds.select("file", F.lit("source_or_context_delta").alias("reason"))]
    rows.append(including(includes, semantic).select("file", F.concat(F.lit("includes:"), "target").alias("reason")))
    by_name = calls.join(names.withColumnRenamed("name", "callee"), "callee", "left_semi").select("file", "callee")
    by_candidate = calls.select("file", "callee", F.explode("candidates").alias("qname")).join(qnames, "qname", "left_semi").select("file", "callee")
    rows.append(by_name.unionByName(by_candidate).select("file", F.concat(F.lit("symbol:"), "callee").alias("reason")))
    ends = pending.select("file", F.explode(F.array("src", "dst")).alias("value")).join(either, "value", "left_semi")
    rows.append(ends.select("file", F.lit("symbolic_edge").alias("reason")))
    rows.append(imports.join(qnames.withColumnRenamed("qname", "module"), "module", "left_semi").select("file", F.concat(F.lit("imports:"), "module").alias("reason")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
