"""The typed query algebra: a JSON tree of eight operators, checked, costed and compiled to DataFrames."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KIND_GROUPS, TRAVERSALS, Graph
from ..operators.graph import oriented, traverse
from .budget import Budget, guard

# Bounds of a query, and each operator's weight in the static cost.
MAX_DEPTH, MAX_NODES, MAX_ROWS, MAX_EDGES = 5, 31, 1000, 100_000
MAX_COST, MAX_PARAMETER_BYTES = 1_000_000, 64 * 1024
MAX_PREDICATE_DEPTH, MAX_PREDICATE_NODES, MAX_CHILDREN, MAX_IN = 5, 256, 16, 256
MAX_COLUMNS, MAX_GROUPS, MAX_AGGREGATES, MAX_SORT_KEYS = 64, 16, 16, 8
MAX_FIELD_BYTES, MAX_TEXT_BYTES, MAX_HOPS = 256, 4096, 5
COST = {"scan": 100, "filter": 10, "project": 5, "join": 500, "aggregate": 50, "traverse": 200, "sort": 20, "limit": 1}

_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.ASCII)
_PARAMETER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}", re.ASCII)
_SYMBOL_FIELDS, _TEXT_FIELDS = {"id", "source", "target"}, {"kind", "name", "path", "relation"}
_VALUE_TYPES = {"text": "string", "integer": "bigint", "boolean": "boolean", "symbol": "string", "file": "string"}
DIRECTIONS = ("inbound", "outbound", "both")
SCAN_COLUMNS = ("id", "kind", "name", "path", "qualified_name", "language", "visibility")


class QueryRejected(ValueError):
    """The query breaks a rule; ``code`` names it."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _need(ok: bool, code: str, detail: str = "") -> None:
    if not ok:
        raise QueryRejected(code, detail)


def _field(name) -> str:
    _need(isinstance(name, str) and len(name) <= MAX_FIELD_BYTES and bool(_FIELD.fullmatch(name)), "malformed", f"field {name!r}")
    return name


def _keys(node: dict, required: set[str], optional: set[str] = frozenset()) -> None:
    _need(isinstance(node, dict) and required <= set(node) <= required | set(optional), "malformed", f"keys {sorted(node)}")


def bind(query: dict, parameters: dict | None = None) -> dict:
    """``query`` with each {"parameter": {"name": ..}} value replaced; every supplied parameter must be used."""
    parameters = parameters or {}
    _need(len(json.dumps(parameters).encode()) <= MAX_PARAMETER_BYTES, "parameter_size_exceeded")
    for name, value in parameters.items():
        _need(bool(_PARAMETER.fullmatch(name)) and "parameter" not in value, "invalid_parameter", name)
    used: set[str] = set()

    def value_of(field: str, value: dict) -> dict:
        if "parameter" not in value:
            return value
        name = value["parameter"].get("name", "")
        _need(bool(_PARAMETER.fullmatch(name)), "invalid_parameter", name)
        _need(name in parameters, "missing_parameter", name)
        bound = parameters[name]
        kind = "symbol" if field in _SYMBOL_FIELDS else "text" if field in _TEXT_FIELDS else None
        _need(kind is None or kind in bound, "type_mismatch", f"{field} takes a {kind}")
        used.add(name)
        return bound

    def predicate(p: dict) -> dict:
        if "predicates" in p:
            return p | {"predicates": [predicate(x) for x in p["predicates"]]}
        if "values" in p:
            return p | {"values": [value_of(p["field"], v) for v in p["values"]]}
        return p | {"value": value_of(p["field"], p["value"])}

    def node(n: dict) -> dict:
        out = {k: node(v) if k in ("input", "left", "right") else v for k, v in n.items()}
        for key in ("filter", "predicate"):
            if out.get(key):
                out[key] = predicate(out[key])
        return out

    bound = node(query)
    _need(set(parameters) <= used, "unexpected_parameter", ", ".join(sorted(set(parameters) - used)))
    return bound


def _check_value(value) -> None:
    _need(isinstance(value, dict) and len(value) == 1, "malformed", "value")
    (kind, x), = value.items()
    _need(kind in _VALUE_TYPES, "malformed", f"value kind {kind}")
    if kind == "integer":
        _need(isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63, "malformed", "integer")
    elif kind == "boolean":
        _need(isinstance(x, bool), "malformed", "boolean")
    else:
        _need(isinstance(x, str) and 1 <= len(x.encode()) <= MAX_TEXT_BYTES, "malformed", kind)


def _check_predicate(p, depth: int = 1, seen: list | None = None) -> None:
    seen = [] if seen is None else seen
    seen.append(1)
    _need(depth <= MAX_PREDICATE_DEPTH, "depth_exceeded", "predicate")
    _need(len(seen) <= MAX_PREDICATE_NODES, "malformed", "predicate nodes")
    kind = p.get("pred") if isinstance(p, dict) else None
    if kind in ("equals", "not_equals"):
        _keys(p, {"pred", "field", "value"})
        _field(p["field"])
        _check_value(p["value"])
    elif kind == "in":
        _keys(p, {"pred", "field", "values"})
        _field(p["field"])
        _need(1 <= len(p["values"]) <= MAX_IN, "malformed", "in")
        for v in p["values"]:
            _check_value(v)
    elif kind in ("and", "or"):
        _keys(p, {"pred", "predicates"})
        _need(1 <= len(p["predicates"]) <= MAX_CHILDREN, "malformed", kind)
        for x in p["predicates"]:
            _check_predicate(x, depth + 1, seen)
    else:
        raise QueryRejected("forbidden_operator", f"predicate {kind}")


def _walk(node, depth: int, found: list[tuple[str, int]]) -> None:
    _need(depth <= MAX_DEPTH, "depth_exceeded")
    op = node.get("op") if isinstance(node, dict) else None
    _need(op in COST, "forbidden_operator", str(op))
    _need(len(found) < MAX_NODES, "malformed", "nodes")
    at = len(found)
    found.append((op, depth))
    if op == "scan":
        _keys(node, {"op", "entity"}, {"filter"})
        _need(node["entity"] in KIND_GROUPS, "malformed", f"entity {node['entity']}")
        if node.get("filter"):
            _check_predicate(node["filter"])
    elif op == "filter":
        _keys(node, {"op", "input", "predicate"})
        _check_predicate(node["predicate"])
    elif op == "project":
        _keys(node, {"op", "input", "columns"})
        _need(1 <= len(node["columns"]) <= MAX_COLUMNS, "malformed", "columns")
        for c in node["columns"]:
            _field(c)
    elif op == "join":
        _keys(node, {"op", "left", "right", "on"})
        _field(node["on"])
    elif op == "aggregate":
        _keys(node, {"op", "input", "group_by", "aggregations"})
        _need(len(node["group_by"]) <= MAX_GROUPS and 1 <= len(node["aggregations"]) <= MAX_AGGREGATES, "malformed", "aggregate")
        for g in node["group_by"]:
            _field(g)
        for a in node["aggregations"]:
            _need(a.get("fn") in ("count", "sum", "min", "max"), "forbidden_operator", str(a.get("fn")))
            if a["fn"] != "count":
                _field(a.get("field"))
    elif op == "traverse":
        _keys(node, {"op", "seed", "relation", "direction"}, {"max_depth"})
        _need(node["relation"] in TRAVERSALS and node["direction"] in DIRECTIONS, "malformed", "traverse")
        _need(1 <= (node.get("max_depth") or 1) <= MAX_HOPS, "traversal_limit_exceeded")
    elif op == "sort":
        _keys(node, {"op", "input", "by"})
        _need(1 <= len(node["by"]) <= MAX_SORT_KEYS, "malformed", "sort")
        for k in node["by"]:
            _field(k.get("field"))
    elif op == "limit":
        _keys(node, {"op", "input", "max_rows"})
        _need(isinstance(node["max_rows"], int) and 1 <= node["max_rows"] <= MAX_ROWS, "row_limit_exceeded")
    for key in ("input", "left", "right"):
        if key in node:
            _walk(node[key], depth + 1, found)
    found.append(found.pop(at))  # operators are listed inside out, as they run


def validate(query: dict, max_rows: int = 100, max_edges: int = 10_000, cost_limit: int | None = None) -> dict:
    """operators (in running order), depth and cost of an acceptable query; raises QueryRejected otherwise."""
    found: list[tuple[str, int]] = []
    _walk(query, 1, found)
    _need(1 <= max_rows <= MAX_ROWS, "row_limit_exceeded")
    _need(1 <= max_edges <= MAX_EDGES, "traversal_limit_exceeded")
    operators = [op for op, _ in found]
    cost = sum(COST[op] for op in operators) * (max_rows // 100 + 1)
    _need(cost <= MAX_COST and (cost_limit is None or cost <= cost_limit), "cost_exceeded", str(cost))
    return {"operators": operators, "depth": max(d for _, d in found), "cost": cost, "max_rows": max_rows, "max_edges": max_edges}


def explain(plan: dict) -> str:
    steps = " -> ".join(op.capitalize() for op in plan["operators"])
    return f"plan: [{steps}] depth={plan['depth']} rows<={plan['max_rows']} traversal<={plan['max_edges']} cost~={plan['cost']}"


def _literal(value: dict) -> Column:
    (kind, x), = value.items()
    return F.lit(x).cast(_VALUE_TYPES[kind])


def _column(df: DataFrame, name: str) -> Column:
    _need(name in df.columns, "unknown_field", name)
    return df[name]


def predicate_column(df: DataFrame, p: dict) -> Column:
    """A null field matches neither ``equals`` nor ``not_equals``."""
    kind = p["pred"]
    if kind in ("and", "or"):
        return reduce(Column.__and__ if kind == "and" else Column.__or__, [predicate_column(df, x) for x in p["predicates"]])
    field = _column(df, p["field"])
    if kind == "in":
        return field.isin(*[next(iter(v.values())) for v in p["values"]])
    return field == _literal(p["value"]) if kind == "equals" else field != _literal(p["value"])


def _sorted(df: DataFrame, by: list[dict]) -> DataFrame:
    keys = [(_column(df, k["field"]).desc_nulls_last() if k.get("descending") else _column(df, k["field"]).asc_nulls_last()) for k in by]
    ties = [df[c].asc_nulls_last() for c in (["id"] if "id" in df.columns else df.columns)]
    return df.orderBy(*keys, *ties)


def compile_node(graph: Graph, node: dict, max_edges: int | None = None) -> DataFrame:
    """The frame of a checked query; with ``max_edges`` a traversal that has to look at more edges is refused."""
    op = node["op"]
    if op == "scan":
        df = graph.entities.where(F.col("kind").isin(*KIND_GROUPS[node["entity"]])).select(*SCAN_COLUMNS)
        return df.where(predicate_column(df, node["filter"])) if node.get("filter") else df
    if op == "join":
        left, right, on = compile_node(graph, node["left"], max_edges), compile_node(graph, node["right"], max_edges), node["on"]
        _column(left, on), _column(right, on)
        clash = set(left.columns) & set(right.columns) - {on}
        right = right.select(*[F.col(c).alias(f"{c}_right" if c in clash else c) for c in right.columns])
        return left.join(right, on)
    if op == "traverse":
        predicates, reverse = TRAVERSALS[node["relation"]]
        direction = node["direction"]
        if reverse:
            direction = {"inbound": "outbound", "outbound": "inbound", "both": "both"}[direction]
        seed = graph.entities.where(F.col("id") == node["seed"]).select("id")
        edges = graph.relations.where(F.col("predicate").isin(*predicates))
        depth = node.get("max_depth") or 1
        found = traverse(edges, seed, direction, depth)
        if max_edges is not None:
            inner = seed.union(found.where(F.col("depth") < depth).select("node"))
            looked_at = oriented(edges.select("subject", "object"), direction).join(inner.select(F.col("id").alias("src")), "src", "left_semi")
            guard(looked_at, "edges", Budget(edges=max_edges))
        return found.select(F.lit(node["seed"]).alias("source"), F.lit(node["relation"]).alias("relation"), F.col("node").alias("target"), "depth")
    df = compile_node(graph, node["input"], max_edges)
    if op == "filter":
        return df.where(predicate_column(df, node["predicate"]))
    if op == "project":
        return df.select(*[_column(df, c) for c in node["columns"]])
    if op == "aggregate":
        out = []
        for a in node["aggregations"]:
            if a["fn"] == "count":
                out.append(F.count(F.lit(1)).alias("count"))
            else:
                out.append(getattr(F, a["fn"])(_column(df, a["field"])).alias(f"{a['fn']}_{a['field']}"))
        groups = [_column(df, g) for g in node["group_by"]]
        return df.groupBy(*groups).agg(*out) if groups else df.agg(*out)
    if op == "sort":
        return _sorted(df, node["by"])
    return df.limit(node["max_rows"])


def run(graph: Graph, query: dict, parameters: dict | None = None, max_rows: int = 100, max_edges: int = 10_000, cost_limit: int | None = None) -> DataFrame:
    """Bind, check, compile; the answer has at most ``max_rows`` rows, and over ``max_edges`` edges BudgetExceeded is raised."""
    bound = bind(query, parameters)
    validate(bound, max_rows, max_edges, cost_limit)
    return compile_node(graph, bound, max_edges).limit(max_rows)
