import itertools
import random

import pytest

from loomgraph.model import Graph
from loomgraph.operators import analytics, graph

E = "id string, kind string, name string, qualified_name string, container_id string, visibility string, tier string, language string, path string"
R = "id string, subject string, predicate string, object string, confidence int"


def make(spark, edges, nodes=(), tier="A"):
    ids = sorted({x for a, _, b, *_ in edges for x in (a, b)} | set(nodes))
    e = spark.createDataFrame([(i, "function", i, i, None, "private", tier, "rust", f"{i}.rs") for i in ids], E)
    r = spark.createDataFrame([(f"{a}{p}{b}", a, p, b, (rest or [900])[0]) for a, p, b, *rest in edges], R)
    return Graph(e, r)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_two_functions(spark):
    g = make(spark, [("caller", "calls", "callee", 950)])
    assert rows(analytics.relationships(g, ["caller"], ["calls"]).select("symbol", "confidence")) == {("callee", 950)}
    assert rows(analytics.flow_trace(g, "caller", ["calls"], "callee")) == {("caller>callee", 1, 950, False, False)}
    assert rows(analytics.flow_frontier(g, "caller", ["calls"])) == {(2, 1, False, 0)}
    changed = spark.createDataFrame([("callee",)], "id string")
    impact = analytics.change_impact(g, changed, ["calls"])
    assert rows(impact) == {("caller", 1, 950, "calls", False, False)}
    assert rows(analytics.risk_summary(impact)) == {("low", 1, 0, 0)}


def test_isolated_is_dead(spark):
    g = make(spark, [("caller", "calls", "callee")], nodes=["isolated"])
    entry = spark.createDataFrame([("caller",)], "id string")
    assert rows(analytics.dead_code(g, entry, ("function",), ["calls"])) == {("isolated", "isolated", 300, "no_incoming_references,not_observed_from_partial_entry_points", 0, 0)}


def test_direct_test_edge(spark):
    g = make(spark, [("t", "tests", "caller"), ("caller", "calls", "callee"), ("t2", "tests", "other")])
    assert rows(analytics.select_tests(g, spark.createDataFrame([("caller",)], "id string"))) == {("t", 900, "direct_test_edge", 1)}
    through = analytics.select_tests(g, spark.createDataFrame([("callee",)], "id string"))
    assert rows(through) == {("t", 600, "via:calls:1", 1)}


def test_low_tier_clamps(spark):
    g = make(spark, [("seed", "dispatch_candidate", "target", 900)], tier="D")
    assert rows(analytics.relationships(g, ["seed"], ["calls"]).select("symbol", "confidence")) == {("target", 399)}


def test_same_snapshot_twice(spark):
    g = make(spark, [("a", "calls", "b")])
    assert analytics.compare(g, g).count() == 0 and analytics.compare_relations(g, g).count() == 0
    assert rows(analytics.lineage(g, g)) == {("a", "a", 1000, False), ("b", "b", 1000, False)}


def test_matrix(spark):
    edges = [("entry", "calls", "alpha"), ("entry", "calls", "beta"), ("left", "calls", "right"), ("right", "calls", "left"), ("root", "calls", "branch"), ("branch", "calls", "leaf"), ("alpha", "calls", "root"), ("beta", "calls", "leaf")]
    g = make(spark, edges, nodes=["probe"])
    found = analytics.cycles(g, ["calls"]).collect()
    assert [(r["size"], r["members"], r["internal_edges"]) for r in found] == [(2, "left,right", 2)]
    assert rows(analytics.representative_cycles(g, ["calls"])) == {("left", "left>right>left", 900)}
    paths = {r["path"] for r in analytics.flow_trace(g, "entry", ["calls"], "leaf").collect()}
    assert paths == {"entry>alpha>root>branch>leaf", "entry>beta>leaf"}
    dag = make(spark, [("n", "calls", "m"), ("m", "calls", "k")])
    assert analytics.cycles(dag, ["calls"]).count() == 0


@pytest.mark.parametrize("closure_edges", [0, 2000])
def test_strong_components_against_brute_force(spark, monkeypatch, closure_edges):
    monkeypatch.setattr(graph, "CLOSURE_EDGES", closure_edges)
    rng = random.Random(11)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    reach = {(a, b) for a, b in edges}
    for k, i, j in itertools.product(nodes, nodes, nodes):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    for k, i, j in itertools.product(nodes, nodes, nodes):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    want = set()
    for a in nodes:
        peers = {b for b in nodes if (a, b) in reach and (b, a) in reach} | {a}
        if len(peers) > 1:
            want.add((a, min(peers)))
    df = spark.createDataFrame(sorted(edges), "subject string, object string")
    assert rows(graph.strong_components(df).select("node", "component")) == want


def test_containers_and_communities(spark):
    e = [("p", "package", None), ("m", "module", "p"), ("c", "class", "m"), ("f", "method", "c"), ("lost", "method", "gone")]
    e = spark.createDataFrame([(i, k, i, i, up, "public", "A", "x", i) for i, k, up in e], E)
    assert rows(graph.container_of(e, ("module",))) == {("p", None), ("m", "m"), ("c", "m"), ("f", "m"), ("lost", None)}
    cliques = [(a, b, 10) for s in ("abc", "xyz") for a, b in itertools.combinations(s, 2)] + [("c", "x", 1)]
    got = dict(rows(graph.communities(spark.createDataFrame(cliques, "subject string, object string, confidence int"))))
    assert len({got[n] for n in "abc"}) == 1 and len({got[n] for n in "xyz"}) == 1 and got["a"] != got["x"]


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], E), spark.createDataFrame([], R))
    assert analytics.cycles(g, ["calls"]).count() == 0
    assert analytics.overview_components(g, ("module",)).count() == 0
    assert graph.reach(g.relations, spark.createDataFrame([("a",)], "id string"), "both", 3).count() == 1


def chain(n, start=0):
    return [(f"v{i:03d}", "calls", f"v{i + 1:03d}") for i in range(start, start + n)]


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_long_chain_is_alive(spark):
    g = make(spark, chain(120), nodes=["lone"])
    assert {r["symbol"] for r in analytics.dead_code(g, ids(spark, "v000"), ("function",), ["calls"]).collect()} == {"lone"}
    found = graph.reach(g.relations, ids(spark, "v000"), "outbound").collect()
    assert len(found) == 121 and max(r["depth"] for r in found) == 120


def test_paths_to_a_weak_target(spark):
    """The strongest walks lead elsewhere; the one to the target is found all the same."""
    g = make(spark, [("s", "calls", "lo", 100), ("lo", "calls", "t", 100)] + [("s", "calls", f"x{i}", 900) for i in range(5)] + [(f"x{i}", "calls", f"y{i}", 900) for i in range(5)])
    assert rows(analytics.flow_trace(g, "s", ["calls"], "t", max_paths=2)) == {("s>lo>t", 2, 100, False, False)}
    some = analytics.flow_trace(g, "s", ["calls"], max_paths=3).collect()
    assert [(r["path"], r["truncated"]) for r in sorted(some, key=lambda r: r["path"])] == [("s>x0", True), ("s>x1", True), ("s>x2", True)]


def test_paths_against_brute_force(spark):
    rng = random.Random(5)
    nodes = "abcdefg"
    edges = sorted({(rng.choice(nodes), "calls", rng.choice(nodes), rng.randrange(1, 900)) for _ in range(18)})
    strongest = {}
    for a, _, b, c in edges:
        strongest[a, b] = max(c, strongest.get((a, b), 0))
    want = []

    def walk(path, confidence):
        for (a, b), c in strongest.items():
            if a == path[-1] and len(path) <= 4:
                want.append((len(path), -min(confidence, c), [*path, b], b in path))
                if b not in path:
                    walk([*path, b], min(confidence, c))

    walk(["a"], 1000)
    g = make(spark, edges, nodes=nodes)
    for limit in (1000, 7):
        got = analytics.flow_trace(g, "a", ["calls"], max_depth=4, max_paths=limit).collect()
        assert {(r["path"], r["hops"], r["confidence"], r["cyclic"]) for r in got} == {(">".join(p), h, -c, y) for h, c, p, y in sorted(want)[:limit]}
        assert all(r["truncated"] == (len(want) > limit) for r in got)
    to_d = analytics.flow_trace(g, "a", ["calls"], "d", max_depth=4, max_paths=1000).collect()
    assert {r["path"] for r in to_d} == {">".join(p) for _, _, p, y in want if p[-1] == "d" and not y and "d" not in p[:-1]}


def test_long_cycle_has_a_representative(spark):
    ring = [(f"n{i:02d}", "calls", f"n{(i + 1) % 12:02d}", 500 + i) for i in range(12)]
    got = analytics.representative_cycles(make(spark, ring), ["calls"]).collect()
    assert [(r["path"], r["confidence"]) for r in got] == [(">".join([f"n{i:02d}" for i in range(12)] + ["n00"]), 500)]
    two = [("a", "calls", "b", 100), ("b", "calls", "a", 900), ("a", "calls", "c", 800), ("c", "calls", "a", 800), ("a", "calls", "d", 800), ("d", "calls", "a", 850)]
    assert rows(analytics.representative_cycles(make(spark, two), ["calls"])) == {("a", "a>c>a", 800)}


@pytest.mark.parametrize("closure_edges", [0, 2000])
def test_components_of_long_cycles_and_tails(spark, monkeypatch, closure_edges):
    monkeypatch.setattr(graph, "CLOSURE_EDGES", closure_edges)
    ring = [(f"r{i:02d}", f"r{(i + 1) % 9:02d}") for i in range(9)]
    tail = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(15)] + [("t15", "r00"), ("r03", "z0"), ("z0", "z1"), ("z1", "z0")]
    got = rows(graph.strong_components(spark.createDataFrame(ring + tail, "subject string, object string")).select("node", "component"))
    assert got == {(a, "r00") for a, _ in ring} | {("z0", "z0"), ("z1", "z0")}


def test_effective_confidence_everywhere(spark):
    g = make(spark, [("a", "calls", "b", 900), ("b", "calls", "a", 900), ("a", "changed_in", "b", 1000)], tier="D")
    (cycle,) = analytics.cycles(g, ["calls"]).collect()
    assert (cycle["edge_weight"], cycle["break_cost"], cycle["change_risk"], cycle["members"]) == (798, 399, 1, "a,b")
    assert rows(analytics.break_candidates(g, ["calls"]).select("cost")) == {(399,)}
    assert rows(analytics.representative_cycles(g, ["calls"])) == {("a", "a>b>a", 399)}
    assert rows(analytics.flow_trace(g, "a", ["calls"], "b").select("confidence")) == {(399,)}
    assert rows(analytics.change_impact(g, ids(spark, "a"), ["calls"]).select("symbol", "confidence")) == {("b", 399)}
    assert rows(analytics.cycle_members(g, ["calls"])) == {("a", "a"), ("a", "b")}
    for rank in ("size", "weight", "change_risk", "break_cost"):
        assert analytics.cycles(g, ["calls"], rank_by=rank).count() == 1


def test_dead_code_policies(spark):
    e = [("open", "function", "public"), ("route", "route", "private"), ("t", "test", "private"), ("used", "function", "private"), ("tested", "function", "private"), ("routed", "function", "private"), ("lone", "function", "private")]
    e = spark.createDataFrame([(i, k, i, i, None, v, "A", "rust", f"{i}.rs") for i, k, v in e], E)
    r = [("open", "used"), ("t", "tested"), ("route", "routed")]
    g = Graph(e, spark.createDataFrame([(a + b, a, "calls", b, 950) for a, b in r], R))
    none = ids(spark, "nothing")
    dead = lambda **k: {x["symbol"] for x in analytics.dead_code(g, none, ("function",), ["calls"], **k).collect()}
    assert dead() == {"used", "routed", "lone"} and dead(policy="library") == {"routed", "lone"}
    assert dead(policy="application") == {"used", "lone"} and dead(policy="explicit") == {"used", "tested", "routed", "lone"}
    assert dead(include_exported=True) == {"open", "used", "routed", "lone"}
    assert rows(analytics.dead_code_suppressions(g, ("function", "test"))) == {("exported", 1), ("test", 1)}
    first = analytics.dead_code(g, none, ("function",), ["calls"]).collect()
    assert [x["symbol"] for x in first] == ["lone", "routed", "used"] and first[1]["classification"] == "strongly_referenced"


def test_explain_sections(spark):
    g = make(spark, [("a", "calls", "b", 900)])
    o = spark.createDataFrame([("o1", "call_site", "a", "b", "a.rs")], "id string, role string, enclosing string, target string, file string")
    p = spark.createDataFrame([("a", "parser", "1.2")], "id string, producer string, version string")
    c = spark.createDataFrame([("language", "rust", "complete"), ("path", "zz", "bounded")], "scope_kind string, scope_id string, status string")
    got = rows(analytics.explain_symbols(g, ["a"], occurrences=o, provenance=p, coverage=c).select("section", "other", "detail"))
    assert got == {("entity", "", "private"), ("outbound", "b", "calls"), ("encloses", "o1", "call_site"), ("provenance", "parser", "1.2"), ("coverage", "rust", "complete")}


def test_test_kinds_and_gaps(spark):
    e = spark.createDataFrame([(i, k, i, i, None, "private", "A", "rust", p) for i, k, p in [("s", "function", "src/a.rs"), ("u", "test", "src/a_test.rs"), ("i", "test", "tests/integration/a.rs"), ("alone", "function", "x/y.rs")]], E)
    g = Graph(e, spark.createDataFrame([("r", "i", "tests", "s", 900)], R))
    pick = lambda **k: rows(analytics.select_tests(g, ids(spark, "s"), **k).select("test", "score", "why"))
    assert pick() == {("i", 900, "direct_test_edge")}
    assert pick(co_located=True) == {("i", 900, "direct_test_edge"), ("u", 300, "co_located")}
    assert pick(co_located=True, kinds=("unit",)) == {("u", 300, "co_located")}
    assert rows(analytics.gaps_of_tests(g, ids(spark, "s", "alone"))) == {("alone",)}


def test_history_kinds(spark):
    row = lambda i, q, sig, c=None: (i, "function", i, q, c, "public", "A", "rust", f"{i}.rs", sig)
    schema = f"{E}, signature string"
    none = spark.createDataFrame([], R)
    base = Graph(spark.createDataFrame([row("a", "a", "()"), row("b", "b", "()"), row("c", "c", "()")], schema), none)
    lineage = spark.createDataFrame([("1", "p", "lineage_split_from", "c", 900), ("2", "q", "lineage_split_from", "c", 900), ("3", "m", "lineage_merged_from", "x", 900), ("4", "m", "lineage_merged_from", "y", 900)], R)
    head = Graph(spark.createDataFrame([row("a", "a", "(int)"), row("b", "b", "()", "box")], schema), lineage)
    assert rows(analytics.compare(base, head).select("id", "change", "significance")) == {("a", "signature_modified", 900), ("b", "moved", 700), ("c", "removed", 1000)}
    assert rows(analytics.compare_lineage(head)) == {("c", "split", 2), ("m", "merged", 2)}


def test_traversal_over_its_edges_is_refused(spark):
    from loomgraph.plans import algebra, budget

    g = make(spark, [("a", "calls", f"b{i}") for i in range(9)])
    q = {"op": "traverse", "seed": "a", "relation": "calls", "direction": "outbound", "max_depth": 2}
    assert algebra.run(g, q, max_edges=9).count() == 9
    with pytest.raises(budget.BudgetExceeded, match="edges"):
        algebra.run(g, q, max_edges=8)


def calls(edges):
    return [(a, "calls", b, c) for a, b, c in edges]


def plain_shortest(edges):
    """{least node of a component: (path, confidence)} by listing all simple cycles."""
    out, best = {}, {}
    for a, b, c in edges:
        out.setdefault(a, {})[b] = max(c, out.get(a, {}).get(b, 0))
    reach = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), {}):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    component = {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in out if a in reach[a]}

    def walk(path, conf):
        for b, c in out.get(path[-1], {}).items():
            if b == path[0] and len(path) > 1:
                key = (len(path), -min(conf, c), (*path, b))
                best[component[b]] = min(best.get(component[b], key), key)
            elif b > path[0] and b not in path:
                walk((*path, b), min(conf, c))

    for a in out:
        walk((a,), 1000)
    return {c: (">".join(k[2]), -k[1]) for c, k in best.items()}


def test_shortest_cycle_away_from_the_least_node(spark):
    """On a ring with a shortcut among later nodes the answer is the shortcut's cycle."""
    ring = [("a", "b", 900), ("b", "c", 900), ("c", "d", 900), ("d", "a", 900), ("c", "b", 500)]
    assert rows(analytics.representative_cycles(make(spark, calls(ring)), ["calls"])) == {("a", "b>c>b", 500)}


def test_shortest_cycles_are_those_of_all_cycles(spark):
    rng = random.Random(11)
    for n, m in ((9, 14), (12, 20)):
        edges = list({(a, b): (a, b, c) for a, b, c in ((f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", rng.choice([300, 600, 900])) for _ in range(m)) if a != b}.values())
        got = {r["component"]: (r["path"], r["confidence"]) for r in analytics.representative_cycles(make(spark, calls(edges)), ["calls"]).collect()}
        assert got == plain_shortest(edges)


def test_open_walks_are_a_setting(spark):
    """With None all walks are kept, so the answer is whole; a small limit is told."""
    wide = [("s", f"m{k}", 900) for k in range(6)] + [(f"m{k}", f"p{k}", 900 - k) for k in range(6)] + [(f"p{k}", "t", 900) for k in range(6)]
    every = analytics.flow_trace(make(spark, calls(wide)), "s", ["calls"], "t", max_open=None).collect()
    assert len(every) == 6 and not any(r["truncated"] for r in every)
    few = analytics.flow_trace(make(spark, calls(wide)), "s", ["calls"], "t", max_open=2).collect()
    assert len(few) == 2 and all(r["truncated"] for r in few)


def test_coloured_components_broadcast_nothing(spark, monkeypatch):
    """what each round of colouring broadcasts goes through the driver."""
    from loomgraph.operators import graph as steps

    plans, write = [], steps.materialize

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(steps, "materialize", kept)
    monkeypatch.setattr(steps, "CLOSURE_EDGES", 0)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a")], "subject string, object string")
    got = {tuple(r) for r in steps.strong_components(edges).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert plans and not any("Broadcast" in p for p in plans)


def _rows_written(monkeypatch):
    """The rows of each table that steps and analyses write from now on, as (label, rows)."""
    from loomgraph.operators import graph as steps

    written, write = [], steps.materialize

    def kept(df, label):
        out = write(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(steps, "materialize", kept)
    monkeypatch.setattr(analytics, "materialize", kept)
    return written


def test_impact_weighs_only_edges_that_a_hop_meets(spark, monkeypatch):
    """F16, F17, F19: edges far from what changed are neither joined with entities nor written again."""
    far = [(f"x{i}", "calls", f"x{i + 1}", 900) for i in range(60)] + [(f"y{i}", "tests", f"x{i}", 900) for i in range(60)]
    near = [("a", "calls", "b", 900), ("c", "calls", "a", 900), ("d", "calls", "b", 950), ("low", "calls", "b", 200), ("d", "dispatch_candidate", "a", 900), ("t", "tests", "b", 990), ("u", "tests", "a", 900)]
    g = make(spark, far + near)
    changed = spark.createDataFrame([("b",)], "id string")
    written = _rows_written(monkeypatch)
    got = rows(analytics.change_impact(g, changed, ["calls"]))
    assert got == {("a", 1, 900, "calls", False, False), ("d", 1, 950, "calls", False, False), ("c", 2, 900, "calls", False, False)}
    plan = [(r["action"], r["symbol"]) for r in analytics.plan_change(g, changed, ["calls"]).orderBy("step").collect()]
    assert plan == [("edit_target", "b"), ("adapt_dependent", "a"), ("adapt_dependent", "d"), ("adapt_dependent", "c"), ("run_test", "t"), ("run_test", "u")]
    assert written and max(n for _, n in written) < 20


def test_connections_meet_components_once(spark, monkeypatch):
    """graphs of the same entities find their components once; weights and confidence are those of each edge."""
    g = make(spark, [("a1", "calls", "b1", 950), ("a2", "calls", "b1", 700), ("a1", "calls", "b2", 999), ("b1", "calls", "a1", 900), ("a1", "calls", "a2", 900), ("b2", "calls", "gone", 900)], nodes=["A", "B"])
    up = graph.F.when(graph.F.length("id") == 2, graph.F.upper(graph.F.substring("id", 1, 1)))
    e = g.entities.where("id <> 'gone'").withColumns({"container_id": up, "kind": graph.F.when(up.isNull(), "module").otherwise("function"), "tier": graph.F.when(graph.F.col("id") == "b1", "C").otherwise("B")})
    base, head = Graph(e, g.relations), Graph(e, g.relations.where("confidence >= 900"))
    assert rows(analytics.overview_connections(base, ("module",), ["calls"])) == {("A", "B", "calls", 3, 999), ("B", "A", "calls", 1, 699)}
    written = _rows_written(monkeypatch)
    assert rows(analytics.compare_architecture(base, head, ("module",), ["calls"])) == {("A", "B", "calls", "architecture_changed", 3, 2)}
    once = len(written)
    apart = Graph(e.select("*"), head.relations)
    assert rows(analytics.compare_architecture(base, apart, ("module",), ["calls"])) == {("A", "B", "calls", "architecture_changed", 3, 2)}
    assert len(written) - once == 2 * once


def test_trace_weighs_only_edges_that_a_hop_meets(spark, monkeypatch):
    """of a trace's edges only those that its walks meet are joined with entities or grouped."""
    far = [(f"x{i}", "calls", f"x{i + 1}", 900) for i in range(60)]
    g = make(spark, [*far, ("a", "calls", "b", 900), ("a", "dispatch_candidate", "b", 950), ("b", "calls", "c", 800), ("b", "calls", "d", 200), ("c", "calls", "a", 900)], tier="B")
    met, give = [], analytics.effective

    def weighed(graph, edges, *rest, **more):
        met.append(edges.count())
        return give(graph, edges, *rest, **more)

    monkeypatch.setattr(analytics, "effective", weighed)
    got = rows(analytics.flow_trace(g, "a", ["calls"], min_confidence=300, max_depth=3))
    assert got == {("a>b", 1, 950, False, False), ("a>b>c", 2, 800, False, False), ("a>b>c>a", 3, 800, True, False)}
    assert met and max(met) <= 2
    assert rows(analytics.flow_trace(g, "a", ["calls"], "c", min_confidence=300)) == {("a>b>c", 2, 800, False, False)}
