"""Scopes and the call graph, against plain stacks and hand-written edges."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import analytics
from loomgraph.model import Graph
from loomgraph.sources import indexing, snapshots, syntax

FILES = {
    "src/gateway.rs": "pub fn submit(value: usize) -> usize {\n    crate::worker::handle(value)\n}\n",
    "src/service.rs": "pub fn transform(value: usize) -> usize { value }\n",
    "src/worker.rs": "use crate::service;\npub struct Pool;\nimpl Pool {\n    pub fn run(&self) -> usize {\n        self.step()\n    }\n    fn step(&self) -> usize {\n        crate::service::transform(1)\n    }\n}\npub fn handle(\n    value: usize,\n) -> usize {\n    Pool::run(&Pool)\n}\n",
    "py/lib.py": 'import os\n\nclass A:\n    """Not code:\ndef fake():\n    """\n\n    def run(self,\n            x):\n        def inner():\n            return helper()\n\n        self.stop()\n        return inner()\n    def stop(self):\n        pass\n\n# def commented():\ndef helper():\n    return other()\n\ndef other(): return 1\n',
    "py/app.py": "from lib import helper as h, A\nimport lib\ndef main():\n    h()\n    lib.other()\n    A.stop(1)\n    unknown()\nmain()\n",
    "web/a.js": "import { draw } from './b'\nimport * as ns from './b'\nclass Box {\n  show(x) {\n    draw(x)\n    this.hide()\n  }\n  hide() {\n    ns.clear()\n  }\n}\nfoo(function () {\n  function deep() {\n    draw()\n  }\n  deep()\n})\n",
    "web/b.js": "export function draw(x) {\n  return '} not a brace {'\n}\nexport function clear() {\n}\n",
    "go/a/x.go": "package a\nfunc (t *T) Go() {\n\tt.Stop()\n\thelp()\n}\ntype T struct {\n}\nfunc (t *T) Stop() {\n}\n",
    "go/a/y.go": "package a\nfunc help() {\n}\n",
    "go/b/z.go": "package b\nimport \"mod/a\"\nfunc Z() {\n\ta.Run()\n}\n",
    "go/mod/a/r.go": "package a\nfunc Run() {\n}\n",
}


def test_call_graph_across_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    store = snapshots.SnapshotStore(spark, str(tmp_path) + "-store")
    indexing.index_repository(spark, str(tmp_path), store, "g1")
    entities = {r["id"]: r for r in store.read("entities").collect()}
    short = lambda i: i.split("#")[1].split("@")[0] if "#" in i else i.split("/")[-1]
    edges = {(short(r["subject"]), r["predicate"], short(r["object"])) for r in store.read("relations").collect()}
    calls = {(a, b) for a, p, b in edges if p == "calls"}
    assert calls == {
        ("submit", "handle"), ("run", "step"), ("step", "transform"), ("handle", "run"),
        ("inner", "helper"), ("run", "stop"), ("run", "inner"), ("helper", "other"), ("main", "helper"), ("main", "other"), ("main", "stop"), ("app.py", "main"),
        ("show", "draw"), ("show", "hide"), ("hide", "clear"), ("deep", "draw"), ("a.js", "deep"), ("Go", "help"), ("Z", "Run"),
    }
    assert {("A", "contains", "run"), ("run", "contains", "inner"), ("Pool", "contains", "run"), ("Box", "contains", "show"), ("T", "contains", "Go"), ("lib.py", "contains", "helper")} <= edges
    assert not any("fake" in i or "commented" in i for i in entities)
    spans = {(short(i), e["line_start"]): e["line_end"] for i, e in entities.items() if "#" in i}
    assert spans[("run", 8)] == 14 and spans[("inner", 10)] == 11 and spans[("A", 3)] == 18 and spans[("handle", 11)] == 15 and spans[("Pool", 2)] == 2
    kinds = {(short(i), e["line_start"]): e["kind"] for i, e in entities.items()}
    assert kinds[("run", 8)] == "method" and kinds[("inner", 10)] == "function" and kinds[("step", 7)] == "method"
    graph = Graph(store.read("entities"), store.read("relations"))
    start = next(i for i in entities if "#submit@" in i)
    flow = {r["path"].count(">"): [short(p) for p in r["path"].split(">")] for r in analytics.flow_trace(graph, start, ["calls"]).collect()}
    assert flow[4] == ["submit", "handle", "run", "step", "transform"]


def plain_scopes(levels, opens):
    """(end, above, inside) of each line, by a stack."""
    stack, out = [], [[None, [], None] for _ in levels]
    for k, level in enumerate(levels):
        if level is not None:
            while stack and levels[stack[-1]] >= level:
                out[stack.pop()][0] = k
            out[k][1] = [x + 1 for x in stack]
            if opens[k]:
                stack.append(k)
        else:
            out[k][1] = [x + 1 for x in stack]
        out[k][2] = stack[-1] + 1 if stack else None
    for k in stack:
        out[k][0] = len(levels)
    return [tuple(x[:1] + [tuple(x[1])] + x[2:]) for x in out]


def test_scopes_are_those_of_a_stack(spark):
    rng = random.Random(5)
    files = {}
    for f in range(60):
        n = rng.choice([1, 2, 5, 40, 200])
        levels = [rng.choice([None, 0, 1, 1, 2, 3, 4, 7]) for _ in range(n)]
        files[f"f{f}"] = (levels, [x is not None and rng.random() < 0.4 for x in levels])
    rows = [(p, "x", "x", k + 1, x, o) for p, (levels, opens) in files.items() for k, (x, o) in enumerate(zip(levels, opens))]
    df = spark.createDataFrame(rows, "path string, language string, line string, line_no int, level int, own boolean")
    got = {(r["path"], r["line_no"]): (r["end"], tuple(r["above"]), r["inside"]) for r in syntax.scopes_of_lines(df, F.col("own")).collect()}
    expected = {(p, k + 1): x for p, (levels, opens) in files.items() for k, x in enumerate(plain_scopes(levels, opens))}
    assert got == expected


def test_levels(spark):
    text = "class A:\n\n    # c\n    x = f(1,\n  2)\n    s = '''\nquoted {\n    '''\n    y = 1\n"
    braces = "int f(\n  int a)\n{\n  /* {\n  { */\n  if (a) { // {\n    g('{', \"}\");\n  }\n}\nint h() {\n"
    df = spark.createDataFrame([("a", "python", text), ("b", "c", braces)], "path string, language string, text string")
    got = {}
    for r in syntax.leveled(df).orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append(r["level"])
    assert got["a"] == [0, None, None, 4, None, 4, None, None, 4, None]
    assert got["b"] == [0, None, 1, None, None, 1, 2, 2, 1, 0, None]


def test_sweep_tells_what_windows_tell(spark):
    """lines are not shuffled, and have the levels and scopes that windows over rows of lines give."""
    rng = random.Random(11)
    bits = ["def f(a,", "class A:", "  ", "    ", "\t", "{", "}", "(", ")", "[", "]", "\'\'\'", '"""', "/*", "*/", "//", "#", "'{'", '"}"', "`x", "`", "fn g() {", "impl T for U {", "func (t *T) Go() {", "x = 1", "end", "end\u00e9", "\r", "\u2028", "\\'", "function k() {", "", "struct S {"]
    text = lambda n: "\n".join("".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 1, 2, 3, 4]))) for _ in range(n))
    rows = [(f"p{i}", (*syntax.DECLARATIONS, "unknown", None)[i % 13], text(rng.choice([0, 1, 3, 30, 60]))) for i in range(260)]
    files = spark.createDataFrame([*rows, ("null", "c", None), ("crlf", "c", "int f(\r\n int a)\r\n{\r\n}\r\n")], "path string, language string, text string")
    got = syntax.scoped_lines(files)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = ["path", "line_no"]
    levels = syntax.leveled(files).select(*key, "level")
    rows_of_lines = got.drop("level", "end", "above", "inside").join(levels, key)
    told = syntax.scopes_of_lines(rows_of_lines, F.size("declared") > 0)
    columns = ["path", "line_no", "level", "end", "above", "inside"]
    as_rows = lambda df: sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect()), key=lambda r: r[:2])
    assert as_rows(got) == as_rows(told) and got.count() == levels.count() > 4000


def test_calls_of_a_line_are_told_apart_there(spark):
    """call sites are not shuffled, and a call that a line makes twice is one use."""
    text = "import os\nclass A(B, x.B):\n    def f(self):\n        g(g(1), g(2)); x.g(); h()\n"
    files = spark.createDataFrame([("p.py", "python", text), ("n.py", "python", None)], "path string, language string, text string")
    calls = syntax.call_sites(syntax.scoped_lines(files))
    assert "Exchange" not in calls._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["text"], r["qualifier"], r["line"], r["inside"]) for r in calls.collect()) == [("g", "", 4, 3), ("g", "x", 4, 3), ("h", "", 4, 3)]
    every = [tuple(r) for r in syntax.uses(files).select("role", "text", "line", "heir", "qualifier", "inside").collect()]
    assert len(every) == len(set(every)) == 5
    assert ("inheritance_use", "B", 2, "A", None, 2) in every


def test_facts_of_some_roles(spark):
    """the uses of the roles asked for alone are kept, and yield the relations that they yield among all."""
    texts = spark.createDataFrame([(p, {"py": "python", "rs": "rust", "js": "javascript", "go": "go"}[p.split(".")[1]], t) for p, t in FILES.items()], "path string, language string, text string")
    every, some = indexing.facts(texts), indexing.facts(texts, roles=("call_site",))
    rows = lambda df: {tuple(r) for r in df.select("subject", "predicate", "object", "confidence").where("predicate IN ('calls', 'dispatch_candidate')").collect()}
    assert rows(some["relations"]) == rows(every["relations"]) != set()
    assert {r[0] for r in some["occurrences"].select("role").distinct().collect()} == {"call_site"}
    assert some["occurrences"].count() == every["occurrences"].where("role = 'call_site'").count()
