"""Workflows over links against a plain walk."""

import random

from loomgraph.operators import graph, workspace


def test_workflow_ranks_the_links_of_its_hops_alone(spark, monkeypatch):
    """A node's first links each way, by a plain walk, with links that come twice; the links of nodes that no hop stands on are not ranked, nor stored."""
    rng = random.Random(3)
    pairs = [(f"c{rng.randrange(30):02}", f"p{rng.randrange(12):02}") for _ in range(160)]
    far = [(f"x{k}", f"y{k % 40}") for k in range(3000)]
    links = spark.createDataFrame(pairs + pairs[:50] + far, "consumer string, provider string")
    seeds = spark.createDataFrame([("c01",), ("p03",)], "id string")
    stored, write = [], graph.materialize

    def written(df, label, *a):
        out = write(df, label, *a)
        stored.append(out.count())
        return out

    for module in (graph, workspace):
        monkeypatch.setattr(module, "materialize", written, raising=False)
    for kind, fanout in (("flow", 3), ("impact", 2), ("context", 2), ("plan", 50)):
        out, back = {}, {}
        for c, p in sorted(set(pairs)):
            out.setdefault(c, []).append(p)
        for p, c in sorted((p, c) for c, p in set(pairs)):
            back.setdefault(p, []).append(c)
        ways = [out] * (kind != "impact") + [back] * (kind != "flow")
        seen, level = {"c01": 0, "p03": 0}, ["c01", "p03"]
        for depth in (1, 2, 3):
            level = sorted({b for a in level for w in ways for b in w.get(a, [])[:fanout]} - seen.keys())
            seen |= dict.fromkeys(level, depth)
        assert {tuple(r) for r in workspace.workflow(links, kind, seeds, 3, fanout).collect()} == set(seen.items())
    assert max(stored) <= 420
