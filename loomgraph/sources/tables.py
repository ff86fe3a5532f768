"""The star-schema tables read as a fact graph, all by plain projections and equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..runtime import dealt

#: Labelled documents test the part of this remainder of their id.
TESTED_PARTS = 200


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _id(table: str, key: str) -> Column:
    return F.concat(F.lit(f"{table}:"), F.col(key).cast("string"))


def _open(balance: str) -> Column:
    return F.when(F.col(balance) > 0, "public").otherwise("private")


def _entity(df: DataFrame, id_, kind, name, qualified, container, visibility, tier, language) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    columns = (id_, kind, name, qualified, container, visibility, tier, language)
    names = ("id", "kind", "name", "qualified_name", "container_id", "visibility", "tier", "language")
    out = df.select(*[lit(c).alias(n) for c, n in zip(columns, names)])
    return out.withColumn("path", F.translate("id", ":", "/"))


def entity_parts(t: Tables) -> dict[str, DataFrame]:
    """Entities of each source table; a query unions only those it needs."""
    dot = lambda *c: F.concat_ws(".", *c)
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return {
        "region": _entity(t.region, _id("region", "r_regionkey"), "package", F.col("r_name"), F.col("r_name"), None, "public", "D", "world"),
        "nation": _entity(nation, _id("nation", "n_nationkey"), "module", F.col("n_name"), dot("r_name", "n_name"), _id("region", "n_regionkey"), "public", "D", "world"),
        "supplier": _entity(t.supplier, _id("supplier", "s_suppkey"), "service", F.col("s_name"), F.col("s_name"), _id("nation", "s_nationkey"), _open("s_acctbal"), "A", "supply"),
        "customer": _entity(t.customer, _id("customer", "c_custkey"), "class", F.col("c_name"), F.col("c_name"), _id("nation", "c_nationkey"), _open("c_acctbal"), "B", F.lower("c_mktsegment")),
        "part": _entity(t.part, _id("part", "p_partkey"), "function", F.col("p_name"), dot("p_type", "p_name"), None, "public", "C", F.col("p_brand")),
        "orders": _entity(t.orders, _id("order", "o_orderkey"), "method", _id("order", "o_orderkey"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "private", "D", F.col("o_orderpriority")),
        "documents": _entity(
            t.documents.join(t.labels.select(F.col("doc_id").alias("labelled")).distinct(), F.col("doc_id") == F.col("labelled"), "left"),
            _id("document", "doc_id"), F.when(F.col("labelled").isNull(), "configuration_key").otherwise("test"), _id("document", "doc_id"), dot("source", _id("document", "doc_id")), None, "public", "D", F.col("lang"),
        ),
    }


def entities(t: Tables, *names: str) -> DataFrame:
    parts = entity_parts(t)
    return reduce(DataFrame.unionByName, [parts[n] for n in (names or parts)])


def _relation(df: DataFrame, subject, predicate: str, object_, confidence) -> DataFrame:
    out = df.select(
        subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"), confidence.cast("int").alias("confidence")
    )
    return out.withColumn("id", F.concat("predicate", F.lit("|"), "subject", F.lit(">"), "object"))


def trade(t: Tables) -> DataFrame:
    """Supplier nation to customer nation, all that trade, by lines."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.sum("n").alias("w"))
    most = pairs.agg(F.max("w").alias("most"))  # one row
    return pairs.join(F.broadcast(most)).withColumn("confidence", F.expr("w * 1000 div most"))


def relation_parts(t: Tables) -> dict[str, DataFrame]:
    contains = [
        _relation(t.nation, _id("region", "n_regionkey"), "contains", _id("nation", "n_nationkey"), F.lit(1000)),
        _relation(t.supplier, _id("nation", "s_nationkey"), "contains", _id("supplier", "s_suppkey"), F.lit(1000)),
        _relation(t.customer, _id("nation", "c_nationkey"), "contains", _id("customer", "c_custkey"), F.lit(1000)),
    ]
    calls = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    # Few lines are alike: they are told in parts of a told number, not first in the tasks that scan them.
    depends = dealt(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").distinct()
    tests = t.labels.withColumn("p", F.col("doc_id") % TESTED_PARTS)
    return {
        "contains": reduce(DataFrame.unionByName, contains),
        "declares": _relation(t.orders, _id("customer", "o_custkey"), "declares", _id("order", "o_orderkey"), F.lit(1000)),
        "calls": _relation(calls, _id("order", "l_orderkey"), "calls", _id("part", "l_partkey"), F.least(F.lit(1000), F.floor(F.col("q") * 20))),
        "depends_on": _relation(depends, _id("part", "l_partkey"), "depends_on", _id("supplier", "l_suppkey"), F.lit(900)),
        "tests": _relation(tests, _id("document", "doc_id"), "tests", _id("part", "p"), F.when(F.col("quality") == 1, 900).otherwise(500)),
        "calls_route": _relation(trade(t), _id("nation", "s_nationkey"), "calls_route", _id("nation", "c_nationkey"), F.col("confidence")),
    }


def relations(t: Tables, *names: str) -> DataFrame:
    parts = relation_parts(t)
    return reduce(DataFrame.unionByName, [parts[n] for n in (names or parts)])


def graph(t: Tables, entity_names: tuple[str, ...] = (), relation_names: tuple[str, ...] = ()) -> Graph:
    return Graph(entities(t, *entity_names), relations(t, *relation_names))


#: The same projection as SQL common table expressions; a query's SQL takes those it names.
SQL = {
    "e_region": "SELECT 'region:' || r_regionkey AS id, 'package' AS kind, r_name AS name, r_name AS qualified_name, CAST(NULL AS VARCHAR) AS container_id, 'public' AS visibility, 'D' AS tier, 'world' AS language, 'region/' || r_regionkey AS path FROM region",
    "e_nation": "SELECT 'nation:' || n_nationkey AS id, 'module' AS kind, n_name AS name, r_name || '.' || n_name AS qualified_name, 'region:' || n_regionkey AS container_id, 'public' AS visibility, 'D' AS tier, 'world' AS language, 'nation/' || n_nationkey AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "e_supplier": "SELECT 'supplier:' || s_suppkey AS id, 'service' AS kind, s_name AS name, s_name AS qualified_name, 'nation:' || s_nationkey AS container_id, CASE WHEN s_acctbal > 0 THEN 'public' ELSE 'private' END AS visibility, 'A' AS tier, 'supply' AS language, 'supplier/' || s_suppkey AS path FROM supplier",
    "e_customer": "SELECT 'customer:' || c_custkey AS id, 'class' AS kind, c_name AS name, c_name AS qualified_name, 'nation:' || c_nationkey AS container_id, CASE WHEN c_acctbal > 0 THEN 'public' ELSE 'private' END AS visibility, 'B' AS tier, lower(c_mktsegment) AS language, 'customer/' || c_custkey AS path FROM customer",
    "e_part": "SELECT 'part:' || p_partkey AS id, 'function' AS kind, p_name AS name, p_type || '.' || p_name AS qualified_name, CAST(NULL AS VARCHAR) AS container_id, 'public' AS visibility, 'C' AS tier, p_brand AS language, 'part/' || p_partkey AS path FROM part",
    "e_orders": "SELECT 'order:' || o_orderkey AS id, 'method' AS kind, 'order:' || o_orderkey AS name, 'order:' || o_orderkey AS qualified_name, 'customer:' || o_custkey AS container_id, 'private' AS visibility, 'D' AS tier, o_orderpriority AS language, 'order/' || o_orderkey AS path FROM orders",
    "e_documents": "SELECT 'document:' || doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'test' ELSE 'configuration_key' END AS kind, 'document:' || doc_id AS name, source || '.document:' || doc_id AS qualified_name, CAST(NULL AS VARCHAR) AS container_id, 'public' AS visibility, 'D' AS tier, lang AS language, 'document/' || doc_id AS path FROM documents",
    "r_contains": "SELECT 'region:' || n_regionkey AS subject, 'contains' AS predicate, 'nation:' || n_nationkey AS object, 1000 AS confidence FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'contains', 'supplier:' || s_suppkey, 1000 FROM supplier UNION ALL SELECT 'nation:' || c_nationkey, 'contains', 'customer:' || c_custkey, 1000 FROM customer",
    "r_declares": "SELECT 'customer:' || o_custkey AS subject, 'declares' AS predicate, 'order:' || o_orderkey AS object, 1000 AS confidence FROM orders",
    "r_calls": "SELECT 'order:' || l_orderkey AS subject, 'calls' AS predicate, 'part:' || l_partkey AS object, CAST(least(1000, floor(max(l_quantity) * 20)) AS INT) AS confidence FROM lineitem GROUP BY l_orderkey, l_partkey",
    "r_depends_on": "SELECT DISTINCT 'part:' || l_partkey AS subject, 'depends_on' AS predicate, 'supplier:' || l_suppkey AS object, 900 AS confidence FROM lineitem",
    "r_tests": f"SELECT 'document:' || doc_id AS subject, 'tests' AS predicate, 'part:' || (doc_id % {TESTED_PARTS}) AS object, CASE WHEN quality = 1 THEN 900 ELSE 500 END AS confidence FROM labels",
    "r_calls_route": "SELECT 'nation:' || a AS subject, 'calls_route' AS predicate, 'nation:' || b AS object, CAST(w * 1000 // max(w) OVER () AS INT) AS confidence FROM (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)",
}


def with_sql(ctes: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named expressions; E and R are the unions of those whose names begin so."""
    names = ctes.split()
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    for top, mark in (("e", "e_"), ("r", "r_")):
        own = [n for n in names if n.startswith(mark)]
        if own:
            extra = ", predicate || '|' || subject || '>' || object AS id" if top == "r" else ""
            parts.append(f"{top.upper()} AS (" + " UNION ALL ".join(f"SELECT *{extra} FROM {n}" for n in own) + ")")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + (" " if body.lstrip().startswith("SELECT") else ", ") + body
