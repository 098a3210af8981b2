"""Design against code: ports, calls, data, boundaries, control, timing; static presence; run validation.

Statuses: MATCH, MISMATCH, UNKNOWN, STALE (held at the baseline, gone now), UNBOUND, CODE_ONLY and
BOUNDARY_EQUIVALENT. Partial coverage answers UNKNOWN; absence is evidence only where it is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import removed, settled
from graphloom.operators.trace import numbered_everywhere

# Truth classes that prove a relation.
HARD = ("OBSERVED", "RESOLVED")
# Types that cannot stand for each other, design side to code side.
INCOMPATIBLE = {
    "str": ("int", "float", "list", "dict"),
    "string": ("int", "float", "list", "dict"),
    "int": ("str",),
    "float": ("str",),
    "bool": ("str",),
    "dataclass": ("socket", "connection"),
    "matrix": ("socket", "connection"),
}


def incompatible(design: Column, code: Column) -> Column:
    a, b = F.lower(F.trim(design)), F.lower(F.trim(code))
    out = F.lit(False)
    for x, ys in INCOMPATIBLE.items():
        out = out | ((a == x) & b.isin(*ys))
    return out


def _flag(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return rows.select(*keys).distinct().withColumn(name, F.lit(True))


def ports(design: DataFrame, functions: DataFrame, params: DataFrame, baseline: DataFrame) -> DataFrame:
    """binding, name, status of the input ports of bound blocks and of parameters that no design declares.

    design: binding, name, type; functions: binding, sig_ok; params and baseline: binding, name, type.
    """
    key = ["binding", "name"]
    rows = design.select(*key, F.col("type").alias("design_type"), F.lit(True).alias("d")).join(params.select(*key, F.col("type").alias("code_type"), F.lit(True).alias("c")), key, "full_outer")
    rows = rows.join(functions, "binding").join(_flag(baseline, key, "b"), key, "left").join(_flag(design, ["binding"], "known"), "binding", "left_semi")
    typed = F.when(F.coalesce("design_type", F.lit("")) == "", "UNKNOWN").when(F.coalesce("code_type", F.lit("")) == "", "UNKNOWN")
    typed = typed.when(incompatible(F.col("design_type"), F.col("code_type")), "MISMATCH").otherwise("MATCH")
    status = F.when(F.col("d").isNull(), F.when(F.col("sig_ok"), "CODE_ONLY")).when(F.col("c").isNotNull(), typed)
    status = status.when(F.col("b").isNotNull(), "STALE").when(~F.col("sig_ok"), "UNKNOWN").otherwise("MISMATCH")
    return rows.select(*key, status.alias("status")).where("status IS NOT NULL")


def calls(nets: DataFrame, edges: DataFrame, baseline: DataFrame, capability: str) -> DataFrame:
    """src, dst, status of designed calls between bound blocks, and CODE_ONLY calls between such blocks.

    edges: id, src, dst, truth, coverage, resolution, modality, presence (PRESENT by an admitted receipt, or
    UNKNOWN). Of several edges of a pair the first by id is judged.
    """
    key = ["src", "dst"]
    best = edges.groupBy(*key).agg(F.min_by(F.struct("truth", "coverage", "resolution", "modality", "presence"), "id").alias("e"))
    nets = nets.select(*key).distinct()
    proven = F.col("e.truth").isin(*HARD) & (F.col("e.coverage") == "COMPLETE") & (F.col("e.resolution") == "EXACT") & (F.col("e.modality") == "MUST")
    lost = F.when(F.col("b").isNotNull(), "STALE").otherwise("MISMATCH" if capability == "COMPLETE" else "UNKNOWN")
    status = F.when(F.col("e").isNull(), lost).when((F.col("e.presence") == "PRESENT") | proven, "MATCH").otherwise("UNKNOWN")
    designed = nets.join(best, key, "left").join(_flag(baseline, key, "b"), key, "left").select(*key, status.alias("status"))
    bound = nets.select(F.col("src").alias("id")).unionByName(nets.select(F.col("dst").alias("id"))).distinct()
    extra = best.select(*key).join(nets, key, "left_anti")
    extra = extra.join(bound.toDF("src"), "src", "left_semi").join(bound.toDF("dst"), "dst", "left_semi")
    return designed.unionByName(extra.withColumn("status", F.lit("CODE_ONLY")))


def data(nets: DataFrame, edges: DataFrame, capability: str) -> DataFrame:
    """src, dst, token, status of designed data nets; an empty token, or an edge without one, fits any.

    edges: id, src, dst, token, truth, coverage.
    """
    key = ["src", "dst", "token"]
    nets = nets.select("src", "dst", F.coalesce(F.trim("token"), F.lit("")).alias("token")).distinct()
    e = edges.select("src", "dst", F.col("token").alias("has"), "id", "truth", "coverage")
    fits = (F.col("token") == "") | F.col("has").isNull() | (F.col("has") == F.col("token"))
    hit = nets.join(e, ["src", "dst"]).where(fits).groupBy(*key).agg(F.min_by(F.struct("truth", "coverage"), "id").alias("e"))
    proven = F.col("e.truth").isin(*HARD) & (F.col("e.coverage") == "COMPLETE")
    status = F.when(F.col("e").isNull(), "MISMATCH" if capability == "COMPLETE" else "UNKNOWN").when(proven, "MATCH").otherwise("UNKNOWN")
    return nets.join(hit, key, "left").select(*key, status.alias("status"))


def crossings(members: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, kind, direction (in or out), token and other end of the edges that cross a unit's border, once each.

    members: unit, id (a node may be of several units); edges: kind, src, dst, token.
    """
    inner = members.select("unit", "id").distinct()
    out = edges.join(inner.toDF("unit", "src"), "src").join(inner.toDF("unit", "dst"), ["unit", "dst"], "left_anti")
    out = out.select("unit", "kind", F.lit("out").alias("direction"), "token", F.col("dst").alias("other"))
    in_ = edges.join(inner.toDF("unit", "dst"), "dst").join(inner.toDF("unit", "src"), ["unit", "src"], "left_anti")
    return out.unionByName(in_.select("unit", "kind", F.lit("in").alias("direction"), "token", F.col("src").alias("other"))).distinct()


def boundaries(units: DataFrame, members: DataFrame, edges: DataFrame, uses: DataFrame, declared: DataFrame) -> DataFrame:
    """unit, aspect (resource, in, out, data, contract or members), status.

    units: unit; uses: id, resource; declared: unit, aspect (in, out or resource), token. A resource that
    the unit does not declare is a MISMATCH; so are data that differ, where all edges have complete
    coverage. Sets are compared as sorted arrays. Without a finding the contract is equivalent.
    """
    cross = crossings(members, edges.where("kind = 'DATA' AND token IS NOT NULL")).select("unit", F.col("direction").alias("aspect"), "token")
    used = members.join(uses, "id").select("unit", F.lit("resource").alias("aspect"), F.col("resource").alias("token"))
    code = cross.unionByName(used).distinct().groupBy("unit", "aspect").agg(F.array_sort(F.collect_set("token")).alias("code"))
    plan = declared.distinct().groupBy("unit", "aspect").agg(F.array_sort(F.collect_set("token")).alias("plan"))
    aspects = units.select("unit", F.explode(F.array(F.lit("in"), F.lit("out"), F.lit("resource"))).alias("aspect"))
    none = F.array().cast("array<string>")
    rows = aspects.join(code, ["unit", "aspect"], "left").join(plan, ["unit", "aspect"], "left")
    rows = rows.select("unit", "aspect", F.coalesce("code", none).alias("code"), F.coalesce("plan", none).alias("plan"))
    seen = edges.where("kind = 'DATA'").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("coverage") == "COMPLETE"), F.lit(False)).alias("complete"))
    rows = rows.withColumns({"n": seen.select("n").scalar(), "complete": seen.select("complete").scalar()})
    rows = rows.join(_flag(members, ["unit"], "bound"), "unit", "left")
    any_data = (F.size("code") > 0) | (F.size("plan") > 0)
    bad = F.when(F.col("aspect") == "resource", F.size(F.array_except("code", "plan")) > 0).otherwise(F.col("complete") & ~(F.col("code").eqNullSafe(F.col("plan"))))
    open_ = (F.col("aspect") != "resource") & ~F.col("complete") & F.when(F.col("n") > 0, any_data).otherwise(F.size("plan") > 0)
    judged = rows.select("unit", "aspect", F.col("bound").isNotNull().alias("bound"), bad.alias("bad"), open_.alias("open"))
    found = judged.where("bound AND bad").select("unit", "aspect", F.lit("MISMATCH").alias("status"))
    by = judged.groupBy("unit").agg(F.first("bound").alias("bound"), F.bool_or("bad").alias("bad"), F.bool_or("open").alias("open"))
    verdict = F.when(~F.col("bound"), F.struct(F.lit("members").alias("aspect"), F.lit("UNBOUND").alias("status")))
    verdict = verdict.when(F.col("open"), F.struct(F.lit("data").alias("aspect"), F.lit("UNKNOWN").alias("status")))
    verdict = verdict.when(~F.col("bad"), F.struct(F.lit("contract").alias("aspect"), F.lit("BOUNDARY_EQUIVALENT").alias("status")))
    return found.unionByName(by.select("unit", verdict.alias("v")).where("v IS NOT NULL").select("unit", "v.*"))


def control(claims: DataFrame, landmarks: DataFrame) -> DataFrame:
    """binding, guard, status of designed branch guards: UNKNOWN without any landmark of the function."""
    any_ = _flag(landmarks, ["binding"], "any")
    rows = claims.select("binding", "guard").distinct().join(_flag(landmarks, ["binding", "guard"], "hit"), ["binding", "guard"], "left").join(any_, "binding", "left")
    status = F.when(F.col("hit").isNotNull(), "MATCH").when(F.col("any").isNull(), "UNKNOWN").otherwise("MISMATCH")
    return rows.select("binding", "guard", status.alias("status"))


def timing(claims: DataFrame, order: DataFrame) -> DataFrame:
    """src, dst, status of MUST_PRECEDE claims; the last edge of a pair, either way, decides.

    order: id, src, dst, modality.
    """
    both = order.select("src", "dst", "id", "modality").unionByName(order.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id", F.lit("CONTRADICTED").alias("modality")))
    last = both.groupBy("src", "dst").agg(F.max_by("modality", "id").alias("m"))
    status = F.when(F.col("m") == "MUST", "MATCH").when(F.col("m") == "CONTRADICTED", "MISMATCH").otherwise("UNKNOWN")
    return claims.select("src", "dst").distinct().join(last, ["src", "dst"], "left").select("src", "dst", status.alias("status"))


def presence(edges: DataFrame, receipts: DataFrame, nodes: DataFrame, kind: str, language: str, lane: str) -> DataFrame:
    """id, state (PRESENT or UNKNOWN), reason: is an edge proven by an admitted receipt of exactly this edge?

    edges: id, kind, src, dst, published; receipts: edge, lane, src, dst, truth, resolution, owner, digest,
    current_digest; nodes: id, language, path. The first step that fails names the reason.
    """
    node = lambda end: nodes.select(F.col("id").alias(end), F.col("language").alias(f"{end}_language"), F.col("path").alias(f"{end}_path"))
    rows = edges.join(node("src"), "src", "left").join(node("dst"), "dst", "left")
    good = F.col("truth").isin(*HARD) & (F.col("resolution") == "EXACT") & (F.col("owner") == F.col("src_path")) & (F.col("digest") == F.col("current_digest"))
    r = receipts.where(F.col("lane") == lane).select(F.col("edge").alias("id"), F.col("src").alias("r_src"), F.col("dst").alias("r_dst"), "truth", "resolution", "owner", "digest", "current_digest")
    j = rows.select("id", "src", "dst", "src_path").join(r, "id")
    by = j.groupBy("id").agg(F.bool_or(good & (F.col("r_src") == F.col("src")) & (F.col("r_dst") == F.col("dst"))).alias("good"))
    known = lambda end: F.coalesce(F.col(f"{end}_language") == language, F.lit(False))
    reason = (
        F.when((F.col("kind") != kind) | F.col("good").isNull(), "unsupported_or_unbound_scope")
        .when(F.col("id") != F.concat_ws(":", F.lit("edge"), "kind", "src", "dst"), "canonical_edge_identity_mismatch")
        .when(~F.col("published"), "canonical_revision_unavailable")
        .when(~known("src") | ~known("dst"), "function_identity_unavailable")
        .when(~F.col("good"), "no_fresh_exact_admission")
        .otherwise("exact_bound_direct_call_admission")
    )
    out = rows.join(by, "id", "left").select("id", reason.alias("reason"))
    return out.select("id", F.when(F.col("reason") == "exact_bound_direct_call_admission", "PRESENT").otherwise("UNKNOWN").alias("state"), "reason")


def static_state(relations: DataFrame, edges: DataFrame, receipts: DataFrame, certificates: DataFrame) -> DataFrame:
    """src, dst, state (PRESENT, MISSING or UNKNOWN), reason.

    relations: src, dst, context; edges: id, src, dst; receipts: edge, context; certificates: src, context,
    complete. Absence needs a complete certificate of the source in the relation's context.
    """
    e = relations.join(edges.select("id", "src", "dst"), ["src", "dst"]).join(receipts.select(F.col("edge").alias("id"), F.col("context").alias("c_")), "id", "left")
    found = e.groupBy("src", "dst", "context").agg(F.coalesce(F.bool_or(F.col("c_") == F.col("context")), F.lit(False)).alias("supported"))
    proof = certificates.groupBy("src", "context").agg(F.bool_or("complete").alias("complete"))
    rows = relations.join(found, ["src", "dst", "context"], "left").join(proof, ["src", "context"], "left")
    reason = (
        F.when(F.col("supported"), "positive_admitted_canonical_relation")
        .when(F.col("supported").isNotNull(), "edge_without_applicable_admitted_support")
        .when(F.col("complete"), "complete_absence_certificate")
        .when(F.col("complete").isNotNull(), "certificate_not_complete")
        .otherwise("no_exact_direct_call_certificate")
    )
    state = F.when(F.col("supported"), "PRESENT").when(F.col("supported").isNull() & F.col("complete"), "MISSING").otherwise("UNKNOWN")
    return rows.select("src", "dst", "context", state.alias("state"), reason.alias("reason"))


def verdicts(relations: DataFrame, runs: DataFrame) -> DataFrame:
    """src, dst, results (labels, joined) and expected_actual of relations (src, dst, design, static) with runs (src, dst, state)."""
    by = runs.groupBy("src", "dst").agg(*[F.bool_or(F.col("state") == s).alias(s.lower()) for s in ("OBSERVED", "NOT_OBSERVED", "UNMEASURED")])
    j = relations.join(by, ["src", "dst"], "left")
    none = F.col("observed").isNull()
    is_ = lambda s: F.coalesce(F.col(s), F.lit(False))
    expected, static = F.col("design") == "EXPECTED", F.col("static")
    unexpected = (F.col("design") == "NOT_EXPECTED") & (static == "PRESENT")
    labels = [
        F.when(expected & (static == "PRESENT"), "IMPLEMENTED"), F.when(expected & (static == "MISSING"), "IMPLEMENTATION_GAP"),
        F.when(expected & (static == "UNKNOWN"), "STATIC_EVIDENCE_GAP"),
        F.when(expected & (static == "PRESENT") & is_("observed"), "IMPLEMENTED_AND_OBSERVED"),
        F.when(expected & (static == "PRESENT") & is_("not_observed"), "IMPLEMENTED_RUNTIME_NOT_OBSERVED"),
        F.when(expected & (static == "PRESENT") & (is_("unmeasured") | none), "IMPLEMENTED_RUNTIME_UNMEASURED"),
        F.when(expected & (static == "UNKNOWN") & is_("observed"), "STATIC_ANALYSIS_GAP_WITH_RUNTIME_OBSERVATION"),
        F.when(unexpected, "UNEXPECTED_IMPLEMENTATION"), F.when(~expected & ~unexpected, "NO_DEFECT_INFERRED"),
        F.when((static == "MISSING") & is_("observed"), "CROSS_LAYER_CONTRADICTION"),
    ]
    actual = F.when(expected & (static == "PRESENT"), "MATCHED").when(expected & (static == "MISSING"), "MISSING_IMPLEMENTATION").when(unexpected, "UNEXPECTED_IMPLEMENTATION").otherwise("UNKNOWN")
    return j.select("src", "dst", F.array_join(F.array_compact(F.array(*labels)), ",").alias("results"), actual.alias("expected_actual"))


#: The checks of a contradiction between a certificate of absence and a run: name to (expected, observed) column.
AUDIT = {
    "relation_semantics": ("semantics", "cert_semantics"),
    "coverage_certificate_domain": ("subject", "cert_subject"),
    "build_context": ("context", "cert_context"),
    "canonical_revision": ("revision", "run_revision"),
    "runtime_binary_source_identity": ("binary", "run_binary"),
    "runtime_relation_semantics": ("semantics", "run_semantics"),
    "cross_language_bridge_identity": ("bridge", "run_bridge"),
}


def audited(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, check, status: MATCH, MISMATCH, or UNKNOWN where a side is missing, for each of the seven checks."""
    status = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), "UNKNOWN").when(F.col(a).cast("string") == F.col(b).cast("string"), "MATCH").otherwise("MISMATCH")
    checks = F.array(*[F.struct(F.lit(name).alias("check"), status(a, b).alias("status")) for name, (a, b) in AUDIT.items()])
    return rows.select(*keys, F.explode(checks).alias("c")).select(*keys, "c.*")


def validated(runs: DataFrame, key: str, chain: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, valid, reason: the first (reason, condition) of the chain that does not hold, else "valid"."""
    reason = F.lit("valid")
    for name, holds in reversed(chain):
        reason = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(name)
    return runs.select(key, reason.alias("reason")).select(key, (F.col("reason") == "valid").alias("valid"), "reason")


def expected_actual(matched: DataFrame, missing: DataFrame, unproven: DataFrame, unexpected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status: the four sets of a comparison as one table."""
    parts = ((matched, "MATCHED"), (missing, "MISSING_IMPLEMENTATION"), (unproven, "UNKNOWN"), (unexpected, "UNEXPECTED_IMPLEMENTATION"))
    out = None
    for rows, status in parts:
        one = rows.select(*keys).distinct().withColumn("status", F.lit(status))
        out = one if out is None else out.unionByName(one)
    return out


def design_diff(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """kind, object, type: what was added, removed or modified, with the type S1 to S8 of the work that follows.

    Both sides: blocks (id, binding, digest), ports (block, name, direction, digest), nets (kind, src, dst),
    composites (id, digest), resources (block, resource).
    """

    def changes(table: str, keys: Sequence[str], what: str, *more: str) -> DataFrame:
        digest = "digest" if "digest" in before[table].columns else None
        side = lambda rows, n: rows[table].select(*keys, F.lit(True).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ([digest] if digest else []) + list(more)])
        j = side(before, "a").join(side(after, "b"), list(keys), "full_outer")
        kind = F.when(F.col("a").isNull(), f"{what}_added").when(F.col("b").isNull(), f"{what}_removed")
        if digest:
            kind = kind.when(~F.col("a_digest").eqNullSafe(F.col("b_digest")), f"{what}_modified")
        rows = j.withColumn("kind", kind).where("kind IS NOT NULL")
        return rows.withColumn("object", F.concat_ws(":", F.lit(what), *keys))

    blocks = changes("blocks", ["id"], "block", "binding")
    rebound = (F.col("kind") == "block_modified") & ~F.col("a_binding").eqNullSafe(F.col("b_binding"))
    out = blocks.select("kind", "object", F.when((F.col("kind") == "block_added") | rebound, "S1").when(F.col("kind") == "block_removed", "S4").otherwise("S2").alias("type"))
    out = out.unionByName(changes("ports", ["block", "name", "direction"], "port").select("kind", "object", F.lit("S2").alias("type")))
    # a net's kind is part of its key; the change takes the column's name
    named = lambda side: {**side, "nets": side["nets"].withColumnRenamed("kind", "net_kind")}
    before, after = named(before), named(after)
    nets = changes("nets", ["net_kind", "src", "dst"], "net")
    call = F.col("net_kind").isin("control", "call")
    added = F.col("kind") == "net_added"
    out = out.unionByName(nets.select("kind", "object", F.when(added & call, "S3").when(added, "S5").when(call, "S4").otherwise("S6").alias("type")))
    composites = changes("composites", ["id"], "composite").where("kind <> 'composite_removed'")
    out = out.unionByName(composites.select("kind", "object", F.lit("S8").alias("type")))
    # resources of blocks that stay or come
    kept = {**before, "resources": before["resources"].join(after["blocks"].select(F.col("id").alias("block")), "block", "left_semi")}
    before = kept
    return out.unionByName(changes("resources", ["block", "resource"], "resource").select("kind", "object", F.lit("S7").alias("type")))


def unrolled(ports: DataFrame, inner: DataFrame, owner: DataFrame, depth: int = 8) -> DataFrame:
    """port, block: the blocks that ports reach through composite continuations (port, child), at most `depth` deep.

    ports: port; inner: port, child; owner: port, block. A port with children stands for these.
    """
    now = ports.select("port", F.col("port").alias("at")).distinct()
    step = inner.select(F.col("port").alias("at"), "child").distinct()
    out = None
    for k in range(depth + 1):
        leaf = now.join(step, "at", "left_anti")
        out = leaf if out is None else out.unionByName(leaf)
        if k < depth:
            now = now.join(step, "at").select("port", F.col("child").alias("at")).distinct()
    return out.join(owner.select(F.col("port").alias("at"), "block"), "at").select("port", "block").distinct()


def unified(symbols: DataFrame) -> DataFrame:
    """symbol, canonical: declarations of a name stand for its only definition, or for its first declaration by
    file where there is none; several definitions never merge.

    symbols: symbol, name, is_definition, file.
    """
    by = symbols.groupBy("name").agg(
        F.count_if("is_definition").alias("n"), F.min_by("symbol", F.struct((~F.col("is_definition")).alias("x"), F.coalesce("file", F.lit("")).alias("y"), "symbol")).alias("canonical")
    )
    return symbols.join(by.where("n <= 1").select("name", "canonical"), "name").select("symbol", "canonical")


def topology(facts: DataFrame, bindings: DataFrame, resources: DataFrame) -> DataFrame:
    """kind, src, dst, data: CALL, RESOURCE and DATA edges of facts whose subjects are bound exactly, and a chain of
    STATE edges through the writers of each datum.

    facts: fact, kind (CALL, DATA_FLOW, WRITE), subject, target, data; bindings: symbol, canonical, status;
    resources: target, resource. A call whose target is not bound goes to the unknown dynamic target.
    Writers of one datum are linked in a row, not in all pairs; its members are the same.
    """
    exact = bindings.where("status = 'EXACT'").select("symbol", "canonical")
    j = facts.join(exact.toDF("subject", "src"), "subject").join(exact.toDF("target", "dst"), "target", "left").join(resources, "target", "left")
    # four kinds of edges read the joined facts
    j = settled(j.select("kind", "src", "dst", "resource", "data").distinct(), "facts")
    none = F.lit(None).cast("string")
    call = j.where("kind = 'CALL' AND resource IS NULL").select(F.lit("CALL").alias("kind"), "src", F.coalesce("dst", F.lit("[Unknown Dynamic Target]")).alias("dst"), none.alias("data")).distinct()
    use = j.where("kind = 'CALL' AND resource IS NOT NULL").select(F.lit("RESOURCE").alias("kind"), "src", F.col("resource").alias("dst"), none.alias("data")).distinct()
    flow = j.where("kind = 'DATA_FLOW' AND dst IS NOT NULL AND dst <> src AND data IS NOT NULL").select(F.lit("DATA").alias("kind"), "src", "dst", "data").distinct()
    writers = j.where("kind = 'WRITE' AND data IS NOT NULL").select("data", "src").distinct()
    row = writers.withColumn("dst", F.lead("src").over(Window.partitionBy("data").orderBy("src"))).where("dst IS NOT NULL")
    out = settled(call.unionByName(use).unionByName(flow).unionByName(row.select(F.lit("STATE").alias("kind"), "src", "dst", "data")), "topology")
    removed(j)
    return out


def _inside(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """unit and the columns of each pair (src, dst, ...) both ends of which are members (unit, node) of the unit.

    A pair is told to the units of that end which is in fewer of them; of those, the units of the other end stay.
    """
    held = m.groupBy("node").agg(F.count("*").alias("n"))
    of = lambda end, n: held.select(F.col("node").alias(end), F.col("n").alias(n))
    told = pairs.join(of("src", "a_"), "src").join(of("dst", "b_"), "dst")
    less = F.col("a_") <= F.col("b_")
    told = told.select("*", F.when(less, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(less, F.col("dst")).otherwise(F.col("src")).alias("other_")).drop("a_", "b_")
    asked = m.join(told, "node").drop("node").withColumnRenamed("other_", "node")
    return asked.join(m, ["unit", "node"], "left_semi").drop("node")


def features(members: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """unit, internal and crossing edges by kind, resources, uncertainty and declared modules of candidate units.

    members: unit, id; edges: kind, src, dst, resolution, coverage; modules: id, module.
    Ends are counted by node before they meet the members; an edge inside has two ends there, so what crosses is the
    rest. Only pairs of nodes that are both in a unit are told to it.
    """
    kinds = ("CALL", "DATA", "STATE", "RESOURCE")
    m = settled(members.select("unit", F.col("id").alias("node")).distinct(), "members")
    kind = lambda k: F.col("kind") == k
    unknown = F.col("resolution") == "UNKNOWN"
    open_ = F.col("resolution").isin("UNKNOWN", "CANDIDATE_SET") | F.col("coverage").isin("PARTIAL", "UNKNOWN")
    by_kind = [F.count_if(kind(k)).alias(k.lower()) for k in kinds]
    nodes = m.select("node").distinct()
    by_node = edges.where("src <> dst").select("kind", "resolution", F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(*by_kind, F.count_if(unknown).alias("unknown"))
    pairs = edges.groupBy("src", "dst").agg(*by_kind, F.count_if(unknown).alias("unknown"), F.count_if(open_).alias("open"))
    for end in ("src", "dst"):
        pairs = pairs.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    inner = _inside(m, pairs)
    names = [k.lower() for k in kinds]
    once = F.col("src") != F.col("dst")
    inner = settled(inner.groupBy("unit").agg(
        *[F.sum(k).alias(f"internal_{k}") for k in names], *[F.sum(F.when(once, F.col(k)).otherwise(0)).alias(f"both_{k}") for k in (*names, "unknown")], F.sum("open").alias("open"),
        F.size(F.collect_set(F.when(F.col("resource") > 0, F.col("dst")))).cast("long").alias("resources"),
    ), "inside")
    ends = m.join(by_node, "node", "left").groupBy("unit").agg(F.count("*").alias("size"), *[F.sum(k).alias(f"ends_{k}") for k in (*names, "unknown")])
    declared = m.join(modules.select(F.col("id").alias("node"), "module").distinct(), "node").groupBy("unit").agg(F.count_distinct("module").alias("modules"))
    rows = ends.join(inner, "unit", "left").join(declared, "unit", "left").na.fill(0)
    crossing = lambda k: F.col(f"ends_{k}") - 2 * F.col(f"both_{k}")
    return rows.select(
        "unit", "size", *[f"internal_{k}" for k in names], *[crossing(k).alias(f"crossing_{k}") for k in names],
        (F.col("open") + crossing("unknown")).alias("uncertainty"), "resources", "modules",
    )


def illegal(f: DataFrame) -> Column:
    """Why a unit (features) may not stand: codes, joined; empty if it may."""
    cases = [(F.col("crossing_state") >= 3, "R3_state_crossing_heavy"), (F.col("uncertainty") >= 5, "R6_uncertainty_high"), (F.col("modules") > 2, "cross_declared_mixed")]
    return F.array_join(F.array_compact(F.array(*[F.when(c, code) for c, code in cases])), ",")


def candidates(f: DataFrame, seeds: dict[str, tuple[int, float, float]], state_limit: int = 2) -> DataFrame:
    """unit, seed, confidence, reasons: units of each seed (least members, confidence, loss for a reason).

    f: features with seed. Units of shared state that cross with more state edges stay at 0.35 at most.
    """
    reasons = illegal(f)
    n = F.when(reasons == "", 0).otherwise(F.size(F.split(reasons, ",")))
    confidence, least = F.lit(None).cast("double"), F.lit(None).cast("int")
    for seed, (size, whole, loss) in seeds.items():
        confidence = F.when(F.col("seed") == seed, F.lit(whole) - loss * n).otherwise(confidence)
        least = F.when(F.col("seed") == seed, size).otherwise(least)
    capped = F.when((F.col("seed") == "state") & (F.col("crossing_state") > state_limit), F.least(confidence, F.lit(0.35))).otherwise(confidence)
    return f.where(F.col("size") >= least).select("unit", "seed", F.round(capped, 3).alias("confidence"), reasons.alias("reasons"))


def ranked_candidates(f: DataFrame, data_complete: bool = True) -> DataFrame:
    """candidate, unit, kind, confidence, reasons: the units of four seeds as candidates with ids, fewest reasons first,
    then the best score, then unit and kind.

    f: features with seed (chain, state or call), score, declared (different modules of members, all of them in
    one where 1 and none is without) and data_out (different data that leave). Chains make flows, and composites
    where they have three members at least, keep to one module and let out three data at most.
    """
    reasons = illegal(f)
    n = F.when(reasons == "", 0).otherwise(F.size(F.split(reasons, ",")))
    flow = 0.75 - 0.05 * n
    flow = flow if data_complete else F.least(flow, F.lit(0.4))
    state = 0.6 - 0.05 * n
    state = F.when(F.col("crossing_state") > 2, F.least(state, F.lit(0.35))).otherwise(state)
    composite = F.least(0.7 - 0.05 * n, F.when(F.col("score") > 0, F.col("score") / 8).otherwise(0.3))
    is_ = lambda seed, least: (F.col("seed") == seed) & (F.col("size") >= least)
    made = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.round(c, 3).alias("confidence")))
        for kind, name, test, c in (
            ("FLOW", "flow", is_("chain", 2), flow), ("MODULE", "module", is_("state", 2), state), ("MODULE", "callreg", is_("call", 3), 0.55 - 0.04 * n),
            ("COMPOSITE", "composite", is_("chain", 3) & (F.col("declared") == 1) & (F.col("data_out") <= 3), composite),
        )
    ]))
    rows = f.select("unit", "score", n.alias("n_"), reasons.alias("reasons"), F.explode(made).alias("c")).select("unit", "score", "n_", "reasons", "c.*")
    ranked = numbered_everywhere(rows.withColumn("down_", -F.col("score")), ["n_", "down_", "unit", "name"], "rank")
    return ranked.select(F.concat_ws("-", F.lit("candidate"), "name", (F.col("rank") + 1).cast("string")).alias("candidate"), "unit", "kind", "confidence", "reasons")


def tournament(scored: DataFrame, routes: dict[str, Column], keep: int = 40) -> DataFrame:
    """route, unit, score, rank: the best `keep` units of each route, ties by unit."""
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("route"), F.round(s, 3).alias("score")) for r, s in routes.items()])).alias("x")
    w = Window.partitionBy("route").orderBy(F.desc("score"), "unit")
    rows = scored.select("unit", listed).select("unit", "x.*").withColumn("rank", F.row_number().over(w))
    return rows.where(F.col("rank") <= keep).select("route", "unit", "score", "rank")


def stage_kind(name: Column) -> Column:
    """The kind of a stage from the name of its region."""
    # Prefixes of names and their kinds, in order.
    kinds = [
        ("config", "CONFIGURATION"), ("reinit", "INITIALIZATION"), ("rmatrix", "COMPUTE"), ("rec", "TRANSFORM"), ("transition", "POSTPROCESS"),
        ("cetable", "OUTPUT"), ("ci", "OUTPUT"), ("free", "OTHER"), ("join", "OTHER"), ("set", "PREPARATION"), ("optimize", "PREPARATION"), ("structure", "PREPARATION"),
    ]
    low, out = F.lower(name), F.lit("OTHER")
    for prefix, kind in reversed(kinds):
        out = F.when(low.startswith(prefix), kind).otherwise(out)
    return out


def exposure(hidden: DataFrame, exposed: DataFrame, rule: str) -> DataFrame:
    """Findings (rule, severity, status, subject, token): what a unit hides, as (unit, token), but does not expose."""
    lost = hidden.select("unit", "token").distinct().join(exposed.select("unit", "token").distinct(), ["unit", "token"], "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.lit("WARNING").alias("severity"), F.lit("VIOLATION").alias("status"), F.col("unit").alias("subject"), "token")


def master_flow(calls: DataFrame, flows: DataFrame) -> DataFrame:
    """part (node or edge), kind, src, dst, n, truth, unresolved: a flow as one table.

    calls: src, dst, truth, resolution (CALL edges between regions and what they call); flows: src, dst,
    token (DATA edges). An edge is as sure as its least sure witness; a node counts its unresolved edges.
    """
    worst = F.when(F.bool_and(F.col("truth").isin(*HARD)), "RESOLVED").otherwise("INFERRED")
    call = calls.groupBy("src", "dst").agg(F.count("*").alias("n"), worst.alias("truth"), F.count_if(F.col("resolution") != "EXACT").alias("unresolved"))
    data_ = flows.groupBy("src", "dst").agg(F.count_distinct("token").alias("n")).select("src", "dst", "n", F.lit("RESOLVED").alias("truth"), F.lit(0).cast("long").alias("unresolved"))
    edges = call.withColumn("kind", F.lit("CALL")).unionByName(data_.withColumn("kind", F.lit("DATA")))
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("src"), "truth", "unresolved")
    sure = F.when(F.bool_and(F.col("truth") == "RESOLVED"), "RESOLVED").otherwise("INFERRED")
    nodes = ends.groupBy("src").agg(F.count("*").alias("n"), sure.alias("truth"), F.sum("unresolved").alias("unresolved"))
    nodes = nodes.select(F.lit("node").alias("part"), F.lit("REGION").alias("kind"), "src", F.lit(None).cast("string").alias("dst"), "n", "truth", "unresolved")
    return nodes.unionByName(edges.select(F.lit("edge").alias("part"), "kind", "src", "dst", "n", "truth", "unresolved"))
