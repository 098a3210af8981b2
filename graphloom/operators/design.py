"""Resolution, scenarios, boundaries and planned-against-actual checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import settled
from graphloom.operators.classify import first_match


def why_unresolved(callee: Column, language: Column, definitions: Column, intrinsics: Sequence[str], externals: Sequence[str]) -> Column:
    """Why a call stays open: noise, intrinsic, ambiguous, external, or a missing target."""
    cases = [
        ("parser_noise", ~F.regexp_like(F.coalesce(callee, F.lit("")), F.lit(r"^[A-Za-z_$][A-Za-z0-9_$.]*$"))),
        ("intrinsic", (language == "fortran") & F.lower(callee).isin(*intrinsics)),
        ("ambiguous_symbol", definitions > 1),
        ("true_external", language.isin("c", "cpp", "python") & F.lower(callee).isin(*externals)),
    ]
    return first_match(cases, "missing_target")


def labelled_calls(calls: DataFrame, definitions: DataFrame, elsewhere: DataFrame, intrinsics: Sequence[str], externals: Sequence[str], subscript: Column) -> DataFrame:
    """The calls with why, their label: noise, intrinsic, several definitions, a name mangled from another language,
    external, a subscript that could be a call, or a missing target; the first that holds.

    calls: callee, language and more; definitions: name (lower case), definitions; elsewhere: names (lower
    case) defined in other languages; subscript: is the call an expression with arguments.
    """
    low = F.lower("callee")
    j = calls.withColumn("low_", low).withColumn("bare_", F.regexp_replace(low, "_+$", ""))
    j = j.join(definitions.select(F.col("name").alias("low_"), "definitions"), "low_", "left")
    j = j.join(elsewhere.select(F.col("name").alias("bare_"), F.lit(True).alias("other_")).distinct(), "bare_", "left")
    cases = [
        ("parser_noise", ~F.regexp_like(F.coalesce("callee", F.lit("")), F.lit(r"^[A-Za-z_$][A-Za-z0-9_$.]*$"))),
        ("intrinsic", (F.col("language") == "fortran") & F.col("low_").isin(*intrinsics)),
        ("ambiguous_symbol", F.coalesce("definitions", F.lit(0)) > 1),
        ("cross_language", (F.col("bare_") != F.col("low_")) & F.col("other_").isNotNull()),
        ("true_external", F.col("language").isin("c", "cpp", "python") & F.col("low_").isin(*externals)),
        ("call_vs_array_ambiguous", (F.col("language") == "fortran") & subscript),
    ]
    return j.select(*calls.columns, first_match(cases, "missing_target").alias("why"))


def guard_resolution(expression: Column, tokens: Sequence[str]) -> Column:
    """RUNTIME_DEPENDENT where an identifier is known to come from input, else UNKNOWN: never guessed."""
    names = F.regexp_extract_all(expression, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    return F.when(F.arrays_overlap(names, F.array(*[F.lit(t) for t in tokens])), "RUNTIME_DEPENDENT").otherwise("UNKNOWN")


def scenario_state(guard_family: Column, family: Column) -> Column:
    """TRUE for the scenario's own family, FALSE for another known one, UNKNOWN for none."""
    return F.when(guard_family.isNull(), "UNKNOWN").when(guard_family == family, "TRUE").otherwise("FALSE")


def by_path_or_basename(refs: DataFrame, files: DataFrame, ref: str = "target", path: str = "path") -> DataFrame:
    """ref, found: the exact path, else the only file of that base name."""
    base = lambda c: F.substring_index(c, "/", -1)
    names = files.groupBy(base(path).alias("base_")).agg(F.count("*").alias("n"), F.min(path).alias("only")).where("n = 1").select("base_", "only")
    exact = refs.join(files.select(F.col(path).alias(ref), F.col(path).alias("exact")).distinct(), ref, "left")
    return exact.withColumn("base_", base(ref)).join(names, "base_", "left").select(*refs.columns, F.coalesce("exact", "only").alias("found"))


def best_candidate(refs: DataFrame, known: DataFrame, key: str, candidates: str) -> DataFrame:
    """key, target: the first of the ordered candidates that exists (known: name)."""
    rows = refs.select(key, F.posexplode(candidates).alias("pos", "name")).join(known.select("name").distinct(), "name")
    return rows.groupBy(key).agg(F.min_by("name", "pos").alias("target"))


def bridged(bridges: DataFrame, required: DataFrame, key: str, basis: str, given: str) -> DataFrame:
    """key, valid: does a bridge hold all provenance keys that its basis needs (required: basis, needs)?"""
    j = bridges.join(required, basis, "left")
    return j.select(key, (F.col("needs").isNotNull() & (F.size(F.array_except("needs", given)) == 0)).alias("valid"))


def rejections(features: DataFrame, unit: str, reasons: dict[str, Column]) -> DataFrame:
    """unit, reasons: the codes of the reasons that hold, joined; empty if none."""
    held = F.array_compact(F.array(*[F.when(c, code) for code, c in reasons.items()]))
    return features.select(unit, F.array_join(held, ",").alias("reasons"))


def memberships(rows: DataFrame, symbol: str, scenario: str) -> DataFrame:
    """symbol, scenarios, shared: in how many scenarios a symbol stands."""
    by = rows.groupBy(symbol).agg(F.count_distinct(scenario).alias("scenarios"))
    return by.withColumn("shared", F.when(F.col("scenarios") >= 2, "SHARED").otherwise("SINGLE"))


def stage_edges(edges: DataFrame, stage: DataFrame) -> DataFrame:
    """src_stage, dst_stage, n, weight: edges between different stages (stage: id, stage)."""
    j = edges.join(stage.toDF("src", "src_stage"), "src").join(stage.toDF("dst", "dst_stage"), "dst").where("src_stage <> dst_stage")
    return j.groupBy("src_stage", "dst_stage").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def dominant_child(edges: DataFrame) -> DataFrame:
    """src, dst: each parent's heaviest child, ties by id."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("r_", F.row_number().over(w)).where("r_ = 1").select("src", "dst", "weight")


def gated_delta(before: DataFrame, after: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """key: rows that differ, looked for only in groups whose digests differ."""
    sign = lambda rows, name: rows.groupBy(group).agg(F.sum(F.xxhash64(key, value).cast("decimal(20,0)")).alias(name))
    open_ = sign(before, "a").join(sign(after, "b"), group, "full_outer").where("NOT (a <=> b)").select(group)
    side = lambda rows, name: rows.join(open_, group, "left_semi").select(key, F.col(value).alias(name))
    return side(before, "a").join(side(after, "b"), key, "full_outer").where("NOT (a <=> b)").select(key)


def marked_stale(diffs: DataFrame, changed: DataFrame, bound: DataFrame, key: str) -> DataFrame:
    """key, mark: STALE where the bound symbol changed, UNBOUND where nothing is bound, else KEPT."""
    c, b = changed.select(key, F.lit(1).alias("c_")).distinct(), bound.select(key, F.lit(1).alias("b_")).distinct()
    j = diffs.join(c, key, "left").join(b, key, "left")
    return j.select(key, F.when(F.col("b_").isNull(), "UNBOUND").when(F.col("c_").isNotNull(), "STALE").otherwise("KEPT").alias("mark"))


def path_status(reached: DataFrame, target: str, open_sources: DataFrame) -> DataFrame:
    """One row, status: FOUND, PARTIAL if a reached node has unknown out-edges, else NOT_FOUND."""
    hit = reached.agg(F.bool_or(F.col("id") == target).alias("hit"))
    gap = reached.join(open_sources.select("id"), "id", "left_semi").agg((F.count("*") > 0).alias("gap"))
    return hit.withColumn("gap", gap.scalar()).select(F.when(F.coalesce("hit", F.lit(False)), "FOUND").when(F.col("gap"), "PARTIAL").otherwise("NOT_FOUND").alias("status"))


def propagated(edges: DataFrame, rounds: int) -> DataFrame:
    """id, label: weighted label propagation with ties to the least label, a fixed number of rounds."""
    arcs = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    label = arcs.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = arcs.join(label.toDF("dst", "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        label = settled(votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")), "labels")
    return label


def type_mismatches(edges: DataFrame, ports: DataFrame, compatible: DataFrame) -> DataFrame:
    """src, dst, token: edges whose ends have known types that are not compatible (compatible: a, b)."""
    out = ports.where("direction = 'out'").select(F.col("block").alias("src"), "token", F.col("type").alias("a"))
    in_ = ports.where("direction = 'in'").select(F.col("block").alias("dst"), "token", F.col("type").alias("b"))
    j = edges.join(out, ["src", "token"]).join(in_, ["dst", "token"]).where("a <> 'UNKNOWN' AND b <> 'UNKNOWN' AND a <> b")
    return j.join(compatible, ["a", "b"], "left_anti").select("src", "dst", "token")


def claim_support(claims: DataFrame, edges: DataFrame, keys: Sequence[str], capability: Column) -> DataFrame:
    """keys, status of MUST claims: SUPPORTED, CONTRADICTED (only with complete coverage) or UNSUPPORTED."""
    found = edges.select(*keys).distinct().withColumn("e_", F.lit(1))
    status = F.when(F.col("e_").isNotNull(), "SUPPORTED").when(capability == "COMPLETE", "CONTRADICTED").otherwise("UNSUPPORTED")
    return claims.where("modality = 'MUST'").join(found, list(keys), "left").select(*keys, status.alias("status"))


def exclusive_uses(uses: DataFrame, resource: str, user: str) -> DataFrame:
    """resource, users: exclusive resources with several users."""
    by = uses.groupBy(resource).agg(F.count_distinct(user).alias("users"))
    return by.where("users > 1")


def nearest_scope(uses: DataFrame, ancestors: DataFrame, declared: DataFrame) -> DataFrame:
    """use, resolution, target: the innermost scope that declares a name decides, EXACT or CANDIDATE_SET.

    uses: use, scope, name; ancestors: scope, ancestor, depth (0 for itself); declared: ancestor, name, target.
    The declarations of a name in a scope meet its uses as one row, their least and largest target: these are
    equal if there is only one. So work is by use and ancestor, however often a name is declared.
    """
    ends = declared.groupBy("ancestor", "name").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    # ancestors are often made from a short column, which looks small enough to be broadcast
    found = uses.join(ancestors.hint("merge"), "scope").join(ends, ["ancestor", "name"])
    near = found.groupBy("use", "depth").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = near.groupBy("use").agg(F.min_by(F.struct("low", "high"), "depth").alias("b"))
    one = F.col("b.low") == F.col("b.high")
    resolution = F.when(F.col("b").isNull(), "UNKNOWN").when(one, "EXACT").otherwise("CANDIDATE_SET")
    return uses.join(best, "use", "left").select("use", resolution.alias("resolution"), F.when(one, F.col("b.low")).alias("target"))


def declared_relation(members: DataFrame, unit: str, module: str) -> DataFrame:
    """unit, relation to declared modules: UNRELATED, ALIGNED (one), CONFLICTING (two) or CROSS_CUTTING."""
    by = members.groupBy(unit).agg(F.count_distinct(module).alias("n"))
    relation = F.when(F.col("n") == 0, "UNRELATED").when(F.col("n") == 1, "ALIGNED").when(F.col("n") == 2, "CONFLICTING").otherwise("CROSS_CUTTING")
    return by.select(unit, relation.alias("relation"))


def concentration(edges: DataFrame, end: str = "dst") -> DataFrame:
    """end, share: the part of an end's weight that its heaviest partner has."""
    return edges.groupBy(end).agg(F.round(F.max("weight") / F.sum("weight"), 6).alias("share"))


def direction_violations(edges: DataFrame, ports: DataFrame) -> DataFrame:
    """src, dst, token: edges that leave a port which only takes in, or enter one which only gives out."""
    ways = ports.groupBy("block", "token").agg(F.bool_or(F.col("direction") == "out").alias("gives"), F.bool_or(F.col("direction") == "in").alias("takes"))
    j = edges.join(ways.select(F.col("block").alias("src"), "token", "gives"), ["src", "token"]).join(ways.select(F.col("block").alias("dst"), "token", "takes"), ["dst", "token"])
    return j.where("NOT gives OR NOT takes").select("src", "dst", "token")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, changed: names of the fields that differ, joined; ADDED and REMOVED rows say so."""
    a = before.select(key, F.lit(1).alias("in_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = after.select(key, F.lit(1).alias("in_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    j = a.join(b, key, "full_outer")
    names = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in sorted(fields)])), ",")
    what = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "REMOVED").otherwise(names)
    return j.select(key, what.alias("changed")).where("changed <> ''")


def planned_findings(relations: DataFrame, interfaces: DataFrame, touches: DataFrame, allowed: DataFrame, kinds: Sequence[str], directions: DataFrame) -> DataFrame:
    """subject, check, severity: what is wrong with the changes that a design plans.

    relations: id, src, dst, kind, justification, support; interfaces: id, before, after, adapter; touches: id, path;
    allowed: path (none: everything is); kinds: forbidden relations; directions: src, dst that are forbidden. A cycle
    of planned relations is one finding without a subject.
    """
    from graphloom.operators.graph import _trimmed

    told = lambda rows, check, severity="ERROR": rows.select(F.col("id").alias("subject"), F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    full = relations.where(whole)
    out = [told(relations.where(~whole), "TARGET_MISSING"), told(full.join(directions.select("src", "dst").distinct(), ["src", "dst"], "left_semi"), "ILLEGAL_DIRECTION")]
    out += [told(relations.where(F.col("kind").isin(*kinds)), "FORBIDDEN_RELATION")]
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out += [told(relations.where(~(given("justification") & given("support"))), "UNSUPPORTED", "UNKNOWN")]
    changed = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after")) & ~given("adapter")
    out += [told(interfaces.where(changed), "INTERFACE_MISMATCH")]
    scoped = touches.where(F.lit(not allowed.isEmpty())).join(allowed.select("path").distinct(), "path", "left_anti")
    out += [told(scoped.select("id").distinct(), "SCOPE_CONTRADICTION")]
    arcs = full.select("src", "dst").distinct()
    loops = arcs.where("src = dst").limit(1).unionByName(_trimmed(settled(arcs.where("src <> dst"), "planned")).limit(1)).limit(1)
    out += [told(loops.select(F.lit("").alias("id")), "CYCLE")]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def flows(roots: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: Sequence[str], rounds: int = 1) -> DataFrame:
    """flow, part (block or net), id, src, dst, round: flows of their roots and of what these call.

    roots: flow, id; edges: kind, src, dst; nodes: id, kind. Only nodes of these kinds can be blocks. Each round adds the
    callees of a flow's blocks that are no blocks of it yet; nets are the calls between blocks of a flow.
    """
    fit = nodes.where(F.col("kind").isin(*kinds)).select("id")
    calls = settled(edges.where("kind = 'CALLS'").select("src", "dst").distinct(), "calls")
    front = blocks = settled(roots.select("flow", "id").distinct().join(fit, "id", "left_semi").select("flow", "id", F.lit(0).alias("round")), "blocks")
    for k in range(1, rounds + 1):
        found = front.select("flow", F.col("id").alias("src")).join(calls, "src").select("flow", F.col("dst").alias("id")).distinct()
        found = found.join(fit, "id", "left_semi").join(blocks.select("flow", "id"), ["flow", "id"], "left_anti")
        front = settled(found.select("flow", "id", F.lit(k).alias("round")), "blocks")
        if front.isEmpty():
            break
        blocks = blocks.unionByName(front)
    none = F.lit(None).cast("string")
    end = lambda name, r: blocks.select("flow", F.col("id").alias(name), F.col("round").alias(r))
    nets = end("src", "a").join(calls, "src").join(end("dst", "b"), ["flow", "dst"])
    nets = nets.select("flow", F.lit("net").alias("part"), F.concat_ws(">", "src", "dst").alias("id"), "src", "dst", F.greatest("a", "b").alias("round"))
    return blocks.select("flow", F.lit("block").alias("part"), "id", none.alias("src"), none.alias("dst"), "round").unionByName(nets)


def operations_of(symbols: DataFrame, operations: DataFrame) -> DataFrame:
    """symbol, id, role (actor, callee or both) of the operations that the symbols do or that go to them.

    symbols: symbol; operations: id, actor, callee. The two ends are joined apart: an OR in a join would compare all
    symbols with all operations.
    """
    s = symbols.select("symbol").distinct()
    end = lambda c, n: operations.join(s.withColumnRenamed("symbol", c), c, "left_semi").select(F.col(c).alias("symbol"), "id", F.lit(n).alias("n"))
    both = end("actor", 1).unionByName(end("callee", 2)).distinct().groupBy("symbol", "id").agg(F.sum("n").alias("n"))
    return both.select("symbol", "id", F.when(F.col("n") == 1, "actor").when(F.col("n") == 2, "callee").otherwise("both").alias("role"))


def bindings_between(bindings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The bindings (caller, callee, ...) between the pairs (caller, callee) asked for, each once."""
    return bindings.join(pairs.select("caller", "callee").distinct(), ["caller", "callee"], "left_semi")


def assembled_flow(commands: DataFrame, calls: DataFrame, inits: DataFrame, known: Sequence[str]) -> DataFrame:
    """app, part, kind, id, src, dst, truth, resolution: the master flow of each app as nodes and edges.

    commands: app, command, handler, family (null, or alone in its app: ungrouped); calls: handler, callee, resolved;
    inits: app (apps whose start calls an init); known: callees that are part of the frame. An app has entry, init,
    dispatch and exit; families are regions behind a guard; callees of several families are shared, the others stand
    alone, unknown where any call to them is unresolved.
    """
    none = F.lit(None).cast("string")
    node = lambda rows, kind, id_, truth: rows.select("app", F.lit("node").alias("part"), F.lit(kind).alias("kind"), id_.alias("id"), none.alias("src"), none.alias("dst"), truth.alias("truth"), none.alias("resolution"))
    edge = lambda rows, kind, src, dst, truth, resolution: rows.select("app", F.lit("edge").alias("part"), F.lit(kind).alias("kind"), F.concat_ws(">", src, dst).alias("id"), src.alias("src"), dst.alias("dst"), truth.alias("truth"), resolution.alias("resolution"))
    at = lambda kind, *c: F.concat_ws(":", F.lit(kind), "app", *c)
    lit = F.lit
    sizes = commands.where("family IS NOT NULL").groupBy("app", "family").agg(F.count_distinct("command").alias("n")).where("n > 1").select("app", "family", lit(True).alias("kept"))
    c = settled(commands.join(sizes, ["app", "family"], "left").select("app", "command", "handler", F.when(F.col("kept"), F.col("family")).alias("family")).distinct(), "commands")
    apps = c.select("app").distinct().join(inits.select("app").distinct().withColumn("has", lit(True)), "app", "left").withColumn("seen", F.when(F.col("has"), "OBSERVED").otherwise("DERIVED"))
    out = [node(apps, k, at(k), lit(t)) for k, t in (("entry", "OBSERVED"), ("init", "DERIVED"), ("dispatch", "OBSERVED"), ("exit", "DERIVED"))]
    out += [edge(apps, "flow", at("entry"), at("init"), F.col("seen"), lit("ACTIVE")), edge(apps, "flow", at("init"), at("dispatch"), F.col("seen"), lit("ACTIVE")), edge(apps, "flow", at("dispatch"), at("exit"), lit("DERIVED"), lit("ACTIVE"))]
    regions = c.where("family IS NOT NULL").select("app", "family").distinct()
    out += [node(regions, "region", at("region", "family"), lit("DERIVED")), edge(regions, "guard", at("dispatch"), at("region", "family"), lit("DERIVED"), lit("UNKNOWN"))]
    mine = c.select("app", "command", "family").distinct()
    out += [node(mine.select("app", "command").distinct(), "command", at("command", "command"), lit("OBSERVED"))]
    out += [edge(mine.where("family IS NOT NULL"), "flow", at("region", "family"), at("command", "command"), lit("DERIVED"), lit("ACTIVE"))]
    out += [edge(mine.where("family IS NULL"), "flow", at("dispatch"), at("command", "command"), lit("DERIVED"), lit("UNKNOWN"))]
    made = calls.where(~F.col("callee").isin(*known)).groupBy("handler", "callee").agg(F.bool_and("resolved").alias("resolved"))
    met = settled(c.join(made, "handler").groupBy("app", "command", "family", "callee").agg(F.bool_and("resolved").alias("resolved")), "met")
    by = met.groupBy("app", "callee").agg(F.count_distinct("family").alias("families"), F.bool_and("resolved").alias("sure"))
    kind = F.when(F.col("families") > 1, "shared").when(F.col("sure"), "callee").otherwise("unknown")
    by = settled(by.withColumn("kind_", kind), "callees")
    out += [node(by.where(F.col("kind_") == k), k, at(k, "callee"), lit("OBSERVED")) for k in ("shared", "callee", "unknown")]
    ends = met.join(by.select("app", "callee", "kind_"), ["app", "callee"])
    target = F.concat_ws(":", "kind_", "app", "callee")
    out += [edge(ends, "call", at("command", "command"), target, lit("OBSERVED"), F.when(F.col("resolved"), "EXACT").otherwise("UNKNOWN"))]
    return reduce(DataFrame.unionByName, out)
