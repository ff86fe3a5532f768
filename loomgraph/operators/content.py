"""What became of text that went: renamed, split and merged units by the word runs they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .resolve import _bundled

WORD = r"[^\x20\x09-\x0D]+"


def with_runs(df: DataFrame, size: int = 3) -> DataFrame:
    """``df`` (id, text) as id and runs: hashes of the different runs of ``size`` words; of a shorter text the whole as one, of none no run."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # The words are a column of their own: an expression inside a lambda would be made anew for each run.
    rows = df.where("text IS NOT NULL").select("id", words.alias("words")).where(F.size("words") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("words", i, size), " ")))
    return rows.select("id", F.array_distinct(runs).alias("runs"))


def _classes(removed: DataFrame, added: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(units, pairs): side, id and class of each unit with a word, and (base, head, shared, base_size, head_size) of classes of which one lies in the other to ``threshold`` in 1000 of its runs.

    Units of the same runs are one class. A run that no base and head of two classes share tells nothing
    and is dropped; the others are put in the order of how rare they are. A class that shares so many runs
    with another shares one of all but its last ``needed - 1``: those alone are joined with the other side,
    so a run that many classes hold meets few. Each pair found is then counted in full. What is shuffled by
    run is two numbers: the class, whose last two bits tell its sides, and the run.
    """
    told = F.unhex(F.md5(F.array_join(F.array_sort("runs").cast("array<string>"), ",")))
    side = lambda df, name: with_runs(df).select(F.lit(name).alias("side"), "id", told.alias("key"), "runs")
    every = side(removed, "base").union(side(added, "head"))
    has = lambda name: F.bool_or(F.col("side") == name).alias(name)
    classes = every.groupBy("key").agg(F.first("runs").alias("runs"), has("base"), has("head"))
    number = F.monotonically_increasing_id() * 4 + F.col("base").cast("long") * 2 + F.col("head").cast("long")
    classes = materialize(classes.select("key", number.alias("class"), "runs"), "content-classes")
    # Each has a class. Left: for an inner join the planner would first ask whether a key is null, by an expression that finds the words anew for each run.
    units = materialize(every.drop("runs").join(classes.select("key", "class"), "key", "left").select("side", "id", "class"), "content-units")

    base, head = F.col("class").bitwiseAND(2) != 0, F.col("class").bitwiseAND(1) != 0
    each = classes.select("class", F.explode("runs").alias("run"))
    shared = each.groupBy("run").agg(F.count(F.lit(1)).alias("f"), F.bool_or(base).alias("b"), F.bool_or(head).alias("h")).where("b AND h AND f > 1").select("run", "f")
    shared = materialize(each.join(shared, "run"), "content-shared")
    own = Window.partitionBy("class")
    lead = shared.withColumns({"r": F.row_number().over(own.orderBy("f", "run")), "m": F.count(F.lit(1)).over(own)})
    lead = lead.join(classes.select("class", F.size("runs").alias("n")), "class")
    lead = materialize(lead.where(F.col("r") <= F.col("m") - F.expr(f"({threshold} * n + 999) div 1000") + 1).select("class", "run"), "content-lead")
    of = lambda df, name: df.where(base if name == "base" else head).select(F.col("class").alias(name), "run")
    met = of(lead, "head").join(of(shared, "base"), "run").select("base", "head").union(of(shared, "head").join(of(lead, "base"), "run").select("base", "head")).where("base <> head").distinct()
    # What two classes share is among the runs left, so those alone are shuffled and compared.
    left = materialize(shared.groupBy("class").agg(F.collect_list("run").alias("runs")).join(classes.select("class", F.size("runs").alias("size")), "class"), "content-compared")
    whole = lambda name: left.select(F.col("class").alias(name), F.col("runs").alias(f"{name}_runs"), F.col("size").alias(f"{name}_size"))
    full = met.join(whole("base"), "base").join(whole("head"), "head")
    full = full.select("base", "head", F.size(F.array_intersect("base_runs", "head_runs")).alias("shared"), "base_size", "head_size")
    full = full.where(F.col("shared") * 1000 >= threshold * F.least("base_size", "head_size"))
    size = F.size("runs")
    return units, full.union(classes.where(base & head).select("class", "class", size, size, size))


def _members(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` of classes (base, head) as those of their units. The ids of a class come in bundles, so pairs of units are made row by row and not shuffled."""
    for name in ("base", "head"):
        ids = _bundled(units.where(F.col("side") == name).select(F.col("class").alias(name), F.col("id").alias(f"{name}s")), f"{name}s")
        pairs = pairs.join(ids, name)
    rest = [c for c in pairs.columns if c not in ("base", "head", "bases", "heads")]
    pairs = pairs.select(F.explode("bases").alias("base"), "heads", *rest)
    return pairs.select("base", F.explode("heads").alias("head"), *rest)


def similar_units(removed: DataFrame, added: DataFrame, threshold: int = 500) -> DataFrame:
    """(base, head, shared, base_size, head_size): pairs of a removed and an added unit (id, text) of which one lies in the other to ``threshold`` in 1000 of its runs."""
    units, pairs = _classes(removed, added, threshold)
    return _members(pairs, units)


def content_lineage(removed: DataFrame, added: DataFrame, threshold: int = 500) -> DataFrame:
    """(change, base, head, similarity): what removed units (id, text; ids are unique) became among the added ones.

    renamed: each is the other's best by similarity (shared runs in 1000 of all runs of the two), which
    is ``threshold`` or more; ties go to the least id. Of the rest, split: one of two or more added units
    that lie in the removed one; merged: one of two or more removed units that lie in the added one; lying
    in is ``threshold`` in 1000 of one's own runs. Similarity in 1000 is given for all. Null texts and
    those without words became nothing.

    All is told of classes of units of the same runs: they have the same best, of a class its least id, so
    at most one of a class is renamed. Pairs of units are made for the result alone and are not written.
    """
    units, pairs = _classes(removed, added, threshold)
    pairs = materialize(pairs.withColumn("similarity", F.expr("shared * 1000 div (base_size + head_size - shared)")), "content-pairs")
    held = lambda name: units.where(F.col("side") == name).groupBy(F.col("class").alias(name)).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.min("id").alias(f"{name}_id"))
    named = materialize(pairs.join(held("base"), "base").join(held("head"), "head"), "content-named")
    good = named.where(F.col("similarity") >= threshold)
    first = lambda one, other: good.groupBy(one).agg(F.min(F.struct((-F.col("similarity")).alias("s"), f"{other}_id", other)).alias("m")).select(one, F.col(f"m.{other}").alias(other))
    mutual = materialize(good.join(first("base", "head"), ["base", "head"], "left_semi").join(first("head", "base"), ["base", "head"], "left_semi"), "content-renamed")
    rest, left = named, units
    for name in ("base", "head"):
        gone = mutual.select(name, F.lit(1).alias(f"{name}_gone"))
        rest = rest.join(gone, name, "left").withColumn(f"{name}_n", F.col(f"{name}_n") - F.coalesce(f"{name}_gone", F.lit(0))).where(f"{name}_n > 0").drop(f"{name}_gone")
        left = left.join(mutual.select(F.lit(name).alias("side"), F.col(name).alias("class"), F.col(f"{name}_id").alias("id")), ["side", "class", "id"], "left_anti")
    rest, left = materialize(rest, "content-rest"), materialize(left, "content-left")
    out = mutual.select(F.lit("renamed").alias("change"), F.col("base_id").alias("base"), F.col("head_id").alias("head"), "similarity")
    for change, one, part in (("split", "base", "head"), ("merged", "head", "base")):
        inside = rest.where(F.col("shared") * 1000 >= threshold * F.col(f"{part}_size"))
        several = inside.withColumn("several", F.sum(f"{part}_n").over(Window.partitionBy(one))).where("several > 1")
        out = out.union(_members(several.select("base", "head", F.lit(change).alias("change"), "similarity"), left).select("change", "base", "head", "similarity"))
    return out
