"""Imports that become overlays: runtime traces, commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACE_SCHEMA = "schema string, repository string, generation string, records array<struct<kind:string,subject:string,object:string,count:bigint>>"


class TraceRejected(ValueError):
    pass


def parse_traces(texts: DataFrame, column: str = "value", version: str = "1.0") -> DataFrame:
    """(kind, subject, object, count) of JSON traces; raises on a malformed or unsupported one."""
    parsed = texts.select(F.from_json(F.col(column), TRACE_SCHEMA).alias("t"))
    if not parsed.where(F.col("t").isNull() | F.col("t.records").isNull() | (F.col("t.schema") != version)).isEmpty():
        raise TraceRejected("malformed or unsupported trace")
    return parsed.select(F.explode("t.records").alias("r")).select("r.*")


def trace_overlay(records: DataFrame) -> DataFrame:
    """(kind, subject, object, count, conflict): exact repeats collapse; edges told with different counts are marked."""
    out = records.groupBy("kind", "subject", "object").agg(F.max("count").alias("count"), (F.min("count") != F.max("count")).alias("conflict"))
    return out


def import_trace(records: DataFrame, entities: DataFrame) -> DataFrame:
    """The overlay of a trace; raises if an edge conflicts, a count is not positive or an end is unknown."""
    overlay = trace_overlay(records)
    if not overlay.where("conflict OR count <= 0").isEmpty():
        raise TraceRejected("conflicting or invalid counts")
    ends = overlay.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    if not ends.join(entities.select("id"), "id", "left_anti").isEmpty():
        raise TraceRejected("unknown endpoint")
    return overlay.drop("conflict")


def co_changes(changes: DataFrame, min_together: int = 2) -> DataFrame:
    """(a, b, together, confidence) of files changed in the same commits, every commit counted whatever its size.

    ``changes``: commit, path. Confidence: together over the rarer file's commits, in thousandths. A file
    of fewer than ``min_together`` commits is in no pair and is left out before commits are paired.
    """
    rows = changes.select("commit", "path").distinct()
    each = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_together)
    often = rows.join(each.select("path"), "path")
    pairs = often.withColumnRenamed("path", "a").join(often.withColumnRenamed("path", "b"), "commit").where("a < b")
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= min_together)
    out = both.join(each.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(each.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "together", F.expr("together * 1000 div least(na, nb)").alias("confidence"))


def renames(changes: DataFrame) -> DataFrame:
    """(commit, old_path, new_path, similarity): deletions and additions of one commit with equal content, each content once on either side."""
    gone = changes.where("status = 'deleted'").groupBy("commit", "content_hash").agg(F.min("path").alias("old_path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    new = changes.where("status = 'added'").groupBy("commit", "content_hash").agg(F.min("path").alias("new_path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return gone.join(new, ["commit", "content_hash"]).select("commit", "old_path", "new_path", F.lit(1000).alias("similarity"))
