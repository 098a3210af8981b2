"""Claims: admission, alignment, verdicts, comparison of planned and observed states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def admitted(claims: DataFrame, lanes: DataFrame) -> DataFrame:
    """Claims with reason: ADMITTED, or the first gate that fails.

    lanes: lane, pattern (of producers), truths (array), runtime. A lane without a row is not
    canonical. Runtime lanes never say MUST.
    """
    j = claims.join(lanes, "lane", "left")
    reason = (
        F.when(F.col("pattern").isNull(), "LANE_NOT_CANONICAL")
        .when(~F.regexp_like("producer", F.col("pattern")), "PRODUCER_NOT_ALLOWED")
        .when(~F.array_contains("truths", F.col("truth")), "TRUTH_CLASS_NOT_ALLOWED")
        .when(F.col("runtime") & (F.col("modality") == "MUST"), "RUNTIME_CANNOT_BE_MUST")
        .otherwise("ADMITTED")
    )
    return j.select(*claims.columns, reason.alias("reason"))


def aligned(claims: DataFrame, slot: Sequence[str], lane: str, value: str) -> DataFrame:
    """slot, label: ADMISSION (one lane), CORROBORATION (lanes agree), PROVIDER_CONFLICT, UNKNOWN_PRESERVED."""
    known = F.when(F.col(value) != "UNKNOWN", F.col(value))
    by = claims.groupBy(*slot).agg(F.count_distinct(known).alias("values"), F.count_distinct(F.when(known.isNotNull(), F.col(lane))).alias("lanes"), F.count_if(F.col(value) == "UNKNOWN").alias("unknown"))
    labels = F.array_compact(F.array(
        F.when((F.col("values") == 1) & (F.col("lanes") == 1), "ADMISSION"), F.when((F.col("values") == 1) & (F.col("lanes") > 1), "CORROBORATION"),
        F.when(F.col("values") > 1, "PROVIDER_CONFLICT"), F.when(F.col("unknown") > 0, "UNKNOWN_PRESERVED"),
    ))
    return by.select(*slot, F.explode(labels).alias("label"))


def answer(rows: DataFrame, keys: Sequence[str], truth: str) -> DataFrame:
    """keys, answer: UNKNOWN before INFERRED before KNOWN, over the evidence of each key."""
    has = lambda x: F.bool_or(F.col(truth) == x)
    ordered = F.when(has("UNKNOWN"), "UNKNOWN").when(has("INFERRED") | has("HEURISTIC"), "INFERRED").otherwise("KNOWN")
    return rows.groupBy(*keys).agg(ordered.alias("answer"))


def states(relations: DataFrame, present: DataFrame, keys: Sequence[str], complete: Column, yes: str, no: str, open_: str = "UNKNOWN") -> DataFrame:
    """keys, state: `yes` where present, `no` only where coverage is complete, else `open_`."""
    found = present.select(*keys).distinct().withColumn("p_", F.lit(1))
    state = F.when(F.col("p_").isNotNull(), yes).when(complete, no).otherwise(open_)
    return relations.join(found, list(keys), "left").select(*keys, state.alias("state"))


def verdicts(design: DataFrame, static: DataFrame, runtime: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, verdict from design (EXPECTED, NOT_EXPECTED), static (PRESENT, MISSING) and runtime (OBSERVED, NOT_OBSERVED) states."""
    side = lambda df, name: df.select(*keys, F.col("state").alias(name))
    j = side(design, "d").join(side(static, "s"), list(keys), "full_outer").join(side(runtime, "r"), list(keys), "full_outer")
    d, s, r = (F.coalesce(c, F.lit("UNKNOWN")) for c in ("d", "s", "r"))
    verdict = (
        F.when((d == "EXPECTED") & (s == "PRESENT"), "IMPLEMENTED")
        .when((d == "EXPECTED") & (s == "MISSING"), "GAP")
        .when((d == "NOT_EXPECTED") & ((s == "PRESENT") | (r == "OBSERVED")), "UNEXPECTED")
        .when((s == "MISSING") & (r == "OBSERVED"), "CONTRADICTION")
        .otherwise("UNKNOWN")
    )
    return j.select(*keys, verdict.alias("verdict"))


def first_failure(tests: Sequence[tuple[Column, str]], passed: str = "APPLICABLE") -> Column:
    """The reason of the first test that does not hold; missing values do not hold."""
    out = None
    for holds, reason in tests:
        bad = ~F.coalesce(holds, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out.otherwise(passed)


def block_states(planned: DataFrame, current: DataFrame, baseline: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, status of planned blocks: UNBOUND, STALE (only in the baseline), MISMATCH or MATCH."""
    now = current.select(key, F.struct(*fields).alias("now"))
    old = baseline.select(key, F.lit(1).alias("old")).distinct()
    j = planned.select(key, F.struct(*fields).alias("plan")).join(now, key, "left").join(old, key, "left")
    status = F.when(F.col("now").isNull() & F.col("old").isNotNull(), "STALE").when(F.col("now").isNull(), "UNBOUND").when(F.col("now") != F.col("plan"), "MISMATCH").otherwise("MATCH")
    return j.select(key, status.alias("status"))


def claim_exposure(edges: DataFrame, member: DataFrame, ports: DataFrame) -> DataFrame:
    """unit, token: tokens that cross a unit's boundary without a port of it (member: id, unit; ports: unit, token)."""
    units = edges.join(member.toDF("src", "su"), "src").join(member.toDF("dst", "du"), "dst").where("su <> du")
    crossing = units.select(F.explode(F.array("su", "du")).alias("unit"), "token").distinct()
    return crossing.join(ports.select("unit", "token"), ["unit", "token"], "left_anti")


def alignments(claims: DataFrame, slot: Sequence[str]) -> DataFrame:
    """slot, label, authority, items: what the claims of a slot say together.

    claims: slot, canonical (else a reference), variant, resolution. Each canonical item is admitted. Two or more of
    them agree (CORROBORATION) or conflict (PROVIDER_CONFLICT); references among themselves only disagree. Where there
    are both, a canonical unknown stays one (UNKNOWN_PRESERVED), a common variant corroborates, and none is a
    discrepancy. References never change what is canonical. Counts only are grouped, so a slot may be large.
    """
    kinds = claims.groupBy(*slot, "variant").agg(F.count_if("canonical").alias("c"), F.count_if(~F.col("canonical")).alias("r"), F.count_if(F.col("canonical") & (F.col("resolution") == "UNKNOWN")).alias("u"))
    has = lambda c: F.count_if(F.col(c) > 0)
    by = kinds.groupBy(*slot).agg(
        F.sum("c").alias("nc"), F.sum("r").alias("nr"), F.sum("u").alias("nu"), has("c").alias("vc"), has("r").alias("vr"), F.count_if((F.col("c") > 0) & (F.col("r") > 0)).alias("common")
    )
    c, r, both = F.col("nc"), F.col("nr"), F.col("nc") + F.col("nr")
    told = lambda test, label, authority, n: F.when(test, F.struct(F.lit(label).alias("label"), F.lit(authority).alias("authority"), n.cast("long").alias("items")))
    mixed = (c > 0) & (r > 0)
    labels = F.array_compact(F.array(
        told(c > 0, "CANONICAL_ADMISSION", "CANONICAL_CANDIDATE", c), told((c > 1) & (F.col("vc") == 1), "CORROBORATION", "CANONICAL_CANDIDATE", c),
        told((c > 1) & (F.col("vc") > 1), "PROVIDER_CONFLICT", "CANONICAL_CANDIDATE", c), told((r > 1) & (F.col("vr") > 1), "REFERENCE_DISAGREEMENT", "REFERENCE_EVIDENCE", r),
        told(mixed & (F.col("nu") > 0), "UNKNOWN_PRESERVED", "MIXED", r), told(mixed & (F.col("nu") == 0) & (F.col("common") > 0), "CORROBORATION", "MIXED", both),
        told(mixed & (F.col("nu") == 0) & (F.col("common") == 0), "CANONICAL_REFERENCE_DISCREPANCY", "MIXED", both),
    ))
    return by.select(*slot, F.explode(labels).alias("x")).select(*slot, "x.*")


def runtime_states(asked: DataFrame, runs: DataFrame, edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """relation, run, state, limits: what a run says of a relation.

    asked: relation, run, kind, src, dst and the scope's columns; runs: run, the scope's columns, binding, window,
    integrity, covered, covered_kind, covered_src; edges: run, src, dst (bound exactly). A run of another scope, or
    without exact binding or a window, is UNMEASURED, and never a miss. NOT_OBSERVED needs a complete trace and
    complete coverage of the relation's kind and source.
    """
    mine = runs.select("run", F.lit(True).alias("run_"), *[F.col(c).alias(f"r_{c}") for c in scope], "binding", "window", "integrity", "covered", "covered_kind", "covered_src")
    seen = edges.select("run", "src", "dst").distinct().withColumn("seen", F.lit(True))
    j = asked.join(mine, "run", "left").join(seen, ["run", "src", "dst"], "left")
    off = [F.when(F.col(c).isNull() | ~F.coalesce(F.col(f"r_{c}") == F.col(c), F.lit(False)), f"{c}_missing_or_mismatch") for c in scope]
    off += [F.when(~F.coalesce(F.col("binding") == "EXACT", F.lit(False)), "scenario_binding_not_exact"), F.when(F.col("window").isNull(), "trace_window_unavailable")]
    reason = F.coalesce(*off)
    whole = F.coalesce(F.col("integrity") == "COMPLETE", F.lit(False))
    covered = whole & F.coalesce((F.col("covered") == "COMPLETE") & (F.col("covered_kind") == F.col("kind")) & (F.col("covered_src") == F.col("src")), F.lit(False))
    state = F.when(reason.isNotNull(), "UNMEASURED").when(F.col("seen"), "OBSERVED").when(covered, "NOT_OBSERVED").otherwise("UNMEASURED")
    limits = F.coalesce(reason, F.when(F.col("seen") & ~whole, "trace_integrity_partial").when(F.col("seen"), "").when(covered, "bounded_workload_and_trace_window_only").otherwise("relation_trace_coverage_not_complete"))
    return j.select("relation", "run", state.alias("state"), limits.alias("limits"))
