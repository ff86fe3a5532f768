"""Changed lines and the symbols that hold them."""

import random

from loomgraph.model import Graph
from loomgraph.operators import analytics
from loomgraph.sources import history, indexing, snapshots

rows = lambda df: {tuple(r) for r in df.collect()}


def test_innermost_spans_of_lines(spark):
    """Against a loop over lines and spans: nested spans, long ones, hunks in several bins, empty ones, files without entities."""
    rng = random.Random(2)
    spans, hunks = [], []
    for f in range(12):
        path = f"f{f}"
        if f:
            spans.append((f"{path}#whole", path, "class", 5, 700))
        for k in range(40 if f > 1 else 0):
            a = rng.randrange(5, 690)
            spans.append((f"{path}#{k}", path, rng.choice(["method", "file"]), a, min(700, a + rng.choice([0, 3, 40, 300]))))
        hunks += [(path, a, a + rng.choice([-1, 0, 5, 130])) for a in (rng.randrange(1, 720) for _ in range(6))]
    e = spark.createDataFrame(spans, "id string, path string, kind string, line_start int, line_end int")
    got = rows(analytics.resolve_changes(Graph(e, e), spark.createDataFrame(hunks, "path string, start int, end int")))
    count = {}
    for path, line in {(p, x) for p, a, b in hunks for x in range(a, max(a, b) + 1)}:
        inner = max(((a, -b, i) for i, p, kind, a, b in spans if p == path and kind != "file" and a <= line <= b), default=(0, 0, None))[2]
        count[inner, path] = count.get((inner, path), 0) + 1
    assert got == {(i, p, "symbol_level" if i else "file_level", n) for (i, p), n in count.items()}
    whole = rows(analytics.resolve_changes(Graph(e, e), spark.createDataFrame([("f1",), ("none",)], "path string")))
    assert whole == {("f1#whole", "f1", "symbol_level", None), (None, "none", "file_level", None)}


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/{0}/x.py\n@@ -5,2 +5,3 @@ def b():\n-old\n+new\n@@ -9,4 +10,0 @@\n-gone\n--- a/y.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- /dev/null\n+++ b/z.py\n@@ -0,0 +1 @@\n+1\n"


def test_from_a_diff_to_its_impact(spark, tmp_path):
    """The hunks of a diff, the function that they change, and its callers in other files."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "x.py").write_text("def a():\n    return 1\n\n\ndef b():\n    return a()\n")
    (src / "use.py").write_text("from x import b\ndef u():\n    b()\n")
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    indexing.index_repository(spark, str(src), store, "g")
    hunks = history.read_hunks(spark.createDataFrame([("c1", DIFF.format(str(src)[1:]))], "diff string, text string"))
    assert {r[2:] for r in rows(hunks)} == {(5, 7), (10, 9), (1, 1)}
    graph = Graph(store.read("entities"), store.read("relations"))
    full = next(r["path"] for r in graph.entities.collect() if r["path"].endswith("x.py"))
    changed = hunks.where("path LIKE '%x.py' AND start = 5").selectExpr(f"'{full}' AS path", "start", "end")
    assert {(r["id"] or "").split("#")[-1] for r in analytics.resolve_changes(graph, changed).collect()} == {"b@5", ""}
    impact = {r["symbol"].split("#")[-1] for r in analytics.impact_of_changes(graph, changed, ["calls"]).collect()}
    assert impact == {"u@2"}
