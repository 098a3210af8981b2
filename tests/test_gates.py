"""Judgements and dealt joins against plain Python on small inputs where every case occurs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from graphloom.operators import authority, design, graph, relational


def test_alignments(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.random() < 0.5, rng.choice("ab"), rng.choice(["EXACT"] * 4 + ["UNKNOWN"])) for _ in range(150)]
    got = Counter(tuple(r) for r in authority.alignments(spark.createDataFrame(rows, "slot int, canonical boolean, variant string, resolution string"), ["slot"]).collect())
    want = Counter()
    by = defaultdict(list)
    for slot, *rest in rows:
        by[slot].append(rest)
    for slot, mine in by.items():
        c, r = [x for x in mine if x[0]], [x for x in mine if not x[0]]
        vc, vr = {x[1] for x in c}, {x[1] for x in r}
        if c:
            want[slot, "CANONICAL_ADMISSION", "CANONICAL_CANDIDATE", len(c)] += 1
        if len(c) > 1:
            want[slot, "CORROBORATION" if len(vc) == 1 else "PROVIDER_CONFLICT", "CANONICAL_CANDIDATE", len(c)] += 1
        if len(r) > 1 and len(vr) > 1:
            want[slot, "REFERENCE_DISAGREEMENT", "REFERENCE_EVIDENCE", len(r)] += 1
        if c and r:
            if any(x[2] == "UNKNOWN" for x in c):
                want[slot, "UNKNOWN_PRESERVED", "MIXED", len(r)] += 1
            else:
                want[slot, "CORROBORATION" if vc & vr else "CANONICAL_REFERENCE_DISCREPANCY", "MIXED", len(c) + len(r)] += 1
    assert got == want and len({k[1] for k in want}) == 6


def test_planned_findings(spark):
    df = spark.createDataFrame
    relations = df(
        [("ok", "a", "b", "CALL", "why", "proof"), ("lost", "a", None, "CALL", "why", "proof"), ("back", "b", "c", "CALL", "why", "proof"), ("bad", "c", "a", "OWNS", "why", "proof"), ("bare", "x", "y", "CALL", "", None)],
        "id string, src string, dst string, kind string, justification string, support string",
    )
    interfaces = df([("i1", "f(int)", "f(str)", None), ("i2", "f(int)", "f(str)", "shim"), ("i3", None, "g()", None), ("i4", "h()", "h()", None)], "id string, before string, after string, adapter string")
    touches, allowed = df([("ok", "src/a"), ("bad", "etc/x")], "id string, path string"), df([("src/a",)], "path string")
    directions = df([("b", "c"), ("q", "r")], "src string, dst string")
    run = lambda rel, allow: Counter(tuple(r) for r in design.planned_findings(rel, interfaces, touches, allow, ["OWNS"], directions).collect())
    want = Counter([("lost", "TARGET_MISSING", "ERROR"), ("back", "ILLEGAL_DIRECTION", "ERROR"), ("bad", "FORBIDDEN_RELATION", "ERROR"), ("bare", "UNSUPPORTED", "UNKNOWN"), ("i1", "INTERFACE_MISMATCH", "ERROR"), ("bad", "SCOPE_CONTRADICTION", "ERROR"), ("", "CYCLE", "ERROR")])
    assert run(relations, allowed) == want
    assert run(relations.where("id <> 'bad'"), allowed.where("false")) == want - Counter([("bad", "FORBIDDEN_RELATION", "ERROR"), ("bad", "SCOPE_CONTRADICTION", "ERROR"), ("", "CYCLE", "ERROR")])
    own = df([("self", "s", "s", "CALL", "w", "p")], relations.schema)
    assert ("", "CYCLE", "ERROR") in run(own, allowed)


def test_runtime_states(spark):
    df = spark.createDataFrame
    runs = df(
        [("good", "r1", "EXACT", "w", "COMPLETE", "COMPLETE", "CALL", "a"), ("part", "r1", "EXACT", "w", "PARTIAL", "COMPLETE", "CALL", "a"), ("old", "r0", "EXACT", "w", "COMPLETE", "COMPLETE", "CALL", "a"), ("loose", "r1", "LIKE", "w", "COMPLETE", "COMPLETE", "CALL", "a"), ("shut", "r1", "EXACT", None, "COMPLETE", "COMPLETE", "CALL", "a")],
        "run string, revision string, binding string, window string, integrity string, covered string, covered_kind string, covered_src string",
    )
    asked = df([(run + dst, run, "CALL", "a", dst, "r1") for run in ("good", "part", "old", "loose", "shut", "none") for dst in ("b", "c")] + [("kind", "good", "USE", "a", "c", "r1"), ("void", "good", "CALL", "a", "b", None)], "relation string, run string, kind string, src string, dst string, revision string")
    edges = df([(run, "a", "b") for run in ("good", "part", "old")], "run string, src string, dst string")
    got = {r.relation: (r.state, r.limits) for r in authority.runtime_states(asked, runs, edges, ["revision"]).collect()}
    assert got == {
        "goodb": ("OBSERVED", ""), "goodc": ("NOT_OBSERVED", "bounded_workload_and_trace_window_only"), "partb": ("OBSERVED", "trace_integrity_partial"), "partc": ("UNMEASURED", "relation_trace_coverage_not_complete"),
        "oldb": ("UNMEASURED", "revision_missing_or_mismatch"), "oldc": ("UNMEASURED", "revision_missing_or_mismatch"), "looseb": ("UNMEASURED", "scenario_binding_not_exact"), "loosec": ("UNMEASURED", "scenario_binding_not_exact"),
        "shutb": ("UNMEASURED", "trace_window_unavailable"), "shutc": ("UNMEASURED", "trace_window_unavailable"), "noneb": ("UNMEASURED", "revision_missing_or_mismatch"), "nonec": ("UNMEASURED", "revision_missing_or_mismatch"),
        "kind": ("UNMEASURED", "relation_trace_coverage_not_complete"), "void": ("UNMEASURED", "revision_missing_or_mismatch"),
    }


def test_path_verdicts_and_topology(spark):
    df = spark.createDataFrame
    edges = df([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q")], "src string, dst string")
    pairs = df([("a", "c"), ("a", "d"), ("x", "c"), ("p", "c"), ("a", "a")], "source string, target string")
    open_ = df([("y",)], "id string")
    got = lambda complete: {(r.source, r.target): (r.verdict, r.hops) for r in graph.path_verdicts(edges, pairs, 2, open_, complete).collect()}
    assert got(False) == {("a", "c"): ("FOUND", 2), ("a", "d"): ("UNKNOWN", None), ("x", "c"): ("PARTIAL", None), ("p", "c"): ("UNKNOWN", None), ("a", "a"): ("FOUND", 0)}
    assert got(True)[("p", "c")] == ("NOT_FOUND", None)
    kinds = df([("CALL", "a", "b"), ("USE", "b", "c"), ("CALL", "c", "d"), ("CALL", "z", "a")], "kind string, src string, dst string")
    nodes = df([(n, "N") for n in "abcdz"], "id string, kind string")
    told = {(r.part, r.id, r.distance) for r in graph.topology_of(kinds, nodes, df([("b",)], "id string"), 1, ["CALL"]).collect()}
    assert told == {("node", "b", 0), ("node", "a", 1), ("node", "c", 1), ("edge", "edge:CALL:a:b", 0), ("boundary", "edge:CALL:c:d", 1), ("boundary", "edge:CALL:z:a", 1)}


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_pairs_of_hot_tokens(spark, piece):
    rng = random.Random(5)
    rows = [(i, "hot") for i in range(60)] + [(rng.randrange(60), rng.choice("abcd")) for _ in range(120)] + [(1, None)]
    got = {(r.a, r.b): r.shared for r in relational.sharing_pairs(spark.createDataFrame(rows, "id int, token string"), "id", "token", piece).collect()}
    by = defaultdict(set)
    for i, t in rows:
        if t:
            by[t].add(i)
    want = Counter(p for ids in by.values() for p in combinations(sorted(ids), 2))
    assert got == dict(want)


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_near_equals_the_longer_walk(spark, direction):
    rng = random.Random(6)
    edges = spark.createDataFrame([(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)], "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n1",), ("gone",)], "id string")
    rows = lambda df: sorted((r.id, r.distance) for r in df.collect())
    assert rows(graph.near(edges, seeds, 5, direction)) == rows(graph.bfs(edges, seeds, 5, direction))


def test_flows_expand_by_rounds(spark):
    df = spark.createDataFrame
    edges = df([("CALLS", "a", "b"), ("CALLS", "b", "c"), ("CALLS", "c", "a"), ("CALLS", "b", "note"), ("USES", "a", "z"), ("CALLS", "a", "b")], "kind string, src string, dst string")
    nodes = df([(n, "FN") for n in "abcz"] + [("note", "DOC")], "id string, kind string")
    roots = df([("f", "a"), ("g", "c"), ("g", "note")], "flow string, id string")
    got = {(r.flow, r.id, r.round) for r in design.flows(roots, edges, nodes, ["FN"], 1).collect()}
    assert got == {("f", "a", 0), ("f", "b", 1), ("f", "a>b", 1), ("g", "c", 0), ("g", "a", 1), ("g", "c>a", 1)}
    two = {(r.flow, r.id) for r in design.flows(roots, edges, nodes, ["FN"], 5).collect()}
    assert {("f", "c"), ("f", "c>a"), ("g", "b")} <= two and ("f", "note") not in two


def test_operations_and_bindings(spark):
    df = spark.createDataFrame
    ops = df([(1, "a", "b"), (2, "b", "a"), (3, "a", "a"), (4, "c", "d")], "id int, actor string, callee string")
    got = {(r.symbol, r.id, r.role) for r in design.operations_of(df([("a",), ("a",), ("d",)], "symbol string"), ops).collect()}
    assert got == {("a", 1, "actor"), ("a", 2, "callee"), ("a", 3, "both"), ("d", 4, "callee")}
    rows = df([("a", "b", 1), ("a", "b", 2), ("b", "a", 3)], "caller string, callee string, line int")
    assert sorted(r.line for r in design.bindings_between(rows, df([("a", "b"), ("a", "b")], "caller string, callee string")).collect()) == [1, 2]


def test_assembled_flow(spark):
    df = spark.createDataFrame
    commands = df([("app", "c1", 1, "fam"), ("app", "c2", 2, "fam"), ("app", "d1", 3, "two"), ("app", "d2", 4, "two"), ("app", "alone", 5, "single"), ("app", "none", 6, None)], "app string, command string, handler int, family string")
    calls = df([(1, "both", True), (3, "both", True), (2, "sure", True), (5, "odd", True), (5, "odd", False), (6, "main", True)], "handler int, callee string, resolved boolean")
    rows = design.assembled_flow(commands, calls, df([("app",)], "app string"), ["main"]).collect()
    nodes, edges = ({(r.kind, r.id) for r in rows if r.part == "node"}, {(r.kind, r.src, r.dst, r.truth, r.resolution) for r in rows if r.part == "edge"})
    assert {i for k, i in nodes if k in ("region", "shared", "callee", "unknown")} == {"region:app:fam", "region:app:two", "shared:app:both", "callee:app:sure", "unknown:app:odd"}
    assert {i for k, i in nodes if k == "command"} == {f"command:app:{c}" for c in ("c1", "c2", "d1", "d2", "alone", "none")}
    assert ("flow", "entry:app", "init:app", "OBSERVED", "ACTIVE") in edges and ("guard", "dispatch:app", "region:app:fam", "DERIVED", "UNKNOWN") in edges
    assert ("flow", "dispatch:app", "command:app:alone", "DERIVED", "UNKNOWN") in edges and ("call", "command:app:alone", "unknown:app:odd", "OBSERVED", "UNKNOWN") in edges
    assert ("call", "command:app:c1", "shared:app:both", "OBSERVED", "EXACT") in edges and len(rows) == len(nodes) + len(edges)
