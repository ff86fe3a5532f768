import pytest

from loomgraph.model import Graph
from loomgraph.plans import algebra

SCAN = {"op": "scan", "entity": "function"}
KIND = {"pred": "equals", "field": "kind", "value": {"text": "function"}}


@pytest.fixture(scope="module")
def g(spark):
    e = [("f1", "function", "caller", "m.caller"), ("f2", "function", "callee", "m.callee"), ("c1", "class", "Box", "m.Box"), ("x", "function", None, None)]
    e = spark.createDataFrame([(*r, "m", "public", "A", "rust", "src/" + r[0]) for r in e], "id string, kind string, name string, qualified_name string, container_id string, visibility string, tier string, language string, path string")
    r = spark.createDataFrame([("r1", "f1", "calls", "f2", 900), ("r2", "f2", "dispatch_candidate", "x", 500), ("r3", "f1", "imports", "c1", 900)], "id string, subject string, predicate string, object string, confidence int")
    return Graph(e, r)


def test_count_by_kind(g):
    q = {"op": "aggregate", "group_by": ["kind"], "aggregations": [{"fn": "count"}], "input": SCAN}
    assert [r.asDict() for r in algebra.run(g, q).collect()] == [{"kind": "function", "count": 3}]


def test_explain_and_cost():
    q = {"op": "limit", "max_rows": 5, "input": {"op": "filter", "predicate": KIND, "input": SCAN}}
    plan = algebra.validate(q, max_rows=50)
    assert plan["cost"] == 111 and plan["depth"] == 3
    assert algebra.explain(plan).startswith("plan: [Scan -> Filter -> Limit] depth=3 rows<=50")
    assert algebra.validate(q, max_rows=500)["cost"] == 111 * 6
    with pytest.raises(algebra.QueryRejected, match="cost_exceeded"):
        algebra.validate(q, max_rows=500, cost_limit=100)


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ({"op": "sql", "text": "select 1"}, "forbidden_operator"),
        ({"op": "scan", "entity": "planet"}, "malformed"),
        ({"op": "scan", "entity": "function", "extra": 1}, "malformed"),
        ({"op": "filter", "input": SCAN, "predicate": {"pred": "like", "field": "name", "value": {"text": "a"}}}, "forbidden_operator"),
        ({"op": "filter", "input": SCAN, "predicate": {"pred": "equals", "field": "a b", "value": {"text": "a"}}}, "malformed"),
        ({"op": "filter", "input": SCAN, "predicate": {"pred": "in", "field": "name", "values": []}}, "malformed"),
        ({"op": "filter", "input": SCAN, "predicate": {"pred": "equals", "field": "name", "value": {"text": ""}}}, "malformed"),
        ({"op": "project", "input": SCAN, "columns": []}, "malformed"),
        ({"op": "aggregate", "input": SCAN, "group_by": [], "aggregations": [{"fn": "avg", "field": "name"}]}, "forbidden_operator"),
        ({"op": "traverse", "seed": "f1", "relation": "calls", "direction": "outbound", "max_depth": 6}, "traversal_limit_exceeded"),
        ({"op": "traverse", "seed": "f1", "relation": "eats", "direction": "outbound"}, "malformed"),
        ({"op": "sort", "input": SCAN, "by": []}, "malformed"),
        ({"op": "limit", "input": SCAN, "max_rows": 1001}, "row_limit_exceeded"),
    ],
)
def test_rejections(query, code):
    with pytest.raises(algebra.QueryRejected) as e:
        algebra.validate(query)
    assert e.value.code == code


def test_depth_is_bounded():
    q = SCAN
    for _ in range(5):
        q = {"op": "limit", "input": q, "max_rows": 1}
    with pytest.raises(algebra.QueryRejected, match="depth_exceeded"):
        algebra.validate(q)
    p = KIND
    for _ in range(5):
        p = {"pred": "and", "predicates": [p]}
    with pytest.raises(algebra.QueryRejected, match="depth_exceeded"):
        algebra.validate({"op": "filter", "input": SCAN, "predicate": p})


def test_parameters(g):
    q = {"op": "scan", "entity": "function", "filter": {"pred": "equals", "field": "name", "value": {"parameter": {"name": "n"}}}}
    assert [r["id"] for r in algebra.run(g, q, {"n": {"text": "callee"}}).collect()] == ["f2"]
    for given, code in ((None, "missing_parameter"), ({"n": {"integer": 1}}, "type_mismatch"), ({"n": {"text": "a"}, "m": {"text": "b"}}, "unexpected_parameter"), ({"1n": {"text": "a"}}, "invalid_parameter")):
        with pytest.raises(algebra.QueryRejected) as e:
            algebra.run(g, q, given)
        assert e.value.code == code


def test_nulls_match_nothing_and_come_last(g):
    unequal = {"op": "filter", "input": SCAN, "predicate": {"pred": "not_equals", "field": "name", "value": {"text": "caller"}}}
    assert [r["id"] for r in algebra.run(g, unequal).collect()] == ["f2"]
    by = {"op": "sort", "input": SCAN, "by": [{"field": "name", "descending": True}]}
    assert [r["id"] for r in algebra.run(g, by).collect()] == ["f1", "f2", "x"]
    with pytest.raises(algebra.QueryRejected, match="unknown_field"):
        algebra.run(g, {"op": "project", "input": SCAN, "columns": ["nope"]})


def test_join_suffixes_and_traverse(g):
    q = {"op": "join", "left": SCAN, "right": SCAN, "on": "id"}
    out = algebra.run(g, q)
    assert "name_right" in out.columns and out.count() == 3
    walk = {"op": "traverse", "seed": "f1", "relation": "calls", "direction": "outbound", "max_depth": 5}
    assert {(r["target"], r["depth"]) for r in algebra.run(g, walk).collect()} == {("f2", 1), ("x", 2)}
    back = {"op": "traverse", "seed": "x", "relation": "called_by", "direction": "outbound", "max_depth": 1}
    assert {r["target"] for r in algebra.run(g, back).collect()} == {"f2"}
