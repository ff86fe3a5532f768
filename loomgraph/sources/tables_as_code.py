"""Source files written from the star tables: a class for each customer, a module for each brand, calls where lines of orders are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .tables import Tables


def source_files(t: Tables) -> DataFrame:
    """(path, language, text). An order is a method that calls its parts' functions, imported from their brands, and the customer's next order; a part's function calls its brand's ``unit``."""
    brand = F.concat(F.lit("b"), F.regexp_extract("p_brand", r"(\d+)", 1))
    parts = t.part.select("p_partkey", brand.alias("brand"))
    name = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    bodies = parts.groupBy("brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda p: F.concat(F.lit("def part_"), p.cast("string"), F.lit("():\n    return unit()\n"))), "\n").alias("own"))
    brands = bodies.select(F.concat(F.lit("parts/"), "brand", F.lit(".py")).alias("path"), F.concat(F.lit("# {\ndef unit():\n    return 1\n\n"), "own").alias("text"))

    lines = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    lines = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("o_custkey", "o_orderkey", "brand", "p_partkey", name.alias("name"))
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = lines.groupBy("o_custkey", "o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda p: F.concat(F.lit("        part_"), p.cast("string"), F.lit("()"))), "\n").alias("calls"))
    orders = orders.withColumn("next", following)
    text = F.concat_ws(
        "\n", F.concat(F.lit("    def order_"), F.col("o_orderkey").cast("string"), F.lit("(self):")), "calls", F.when(F.col("next").isNotNull(), F.concat(F.lit("        self.order_"), F.col("next").cast("string"), F.lit("()")))
    )
    methods = orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", text.alias("text"))))["text"], "\n\n").alias("body"))
    imports = lines.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("from parts."), "brand", F.lit(" import "), "name"))), "\n").alias("head"))
    customers = methods.join(imports, "o_custkey").select(
        F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"),
        F.concat("head", F.lit("\n\nclass Customer"), F.col("o_custkey").cast("string"), F.lit(":\n"), "body", F.lit("\n")).alias("text"),
    )
    return customers.union(brands).select("path", F.lit("python").alias("language"), "text")


#: What the files hold, as SQL: ``lines`` of orders and the names of orders and parts.
SQL = """WITH lines AS (SELECT DISTINCT o_custkey, l_orderkey, l_partkey, 'customers/c' || o_custkey || '.py#order_' || l_orderkey AS o, 'parts/b' || regexp_extract(p_brand, '[0-9]+') || '.py#part_' || l_partkey AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
own AS (SELECT DISTINCT o_custkey, l_orderkey, o FROM lines),
following AS (SELECT o, lead(o) OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS n FROM own),
units AS (SELECT 'parts/b' || regexp_extract(p_brand, '[0-9]+') || '.py#' AS f, 'part_' || p_partkey AS p FROM part)
"""
