"""Commit history from the text of a log, split by record and field separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: git log --name-status -M --format=%x1e%H%x1f%at%x1f%an
RECORD, FIELD = "\x1e", "\x1f"
# Change letters of the log.
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, time, author, status, path, old_path, similarity): a row for each change; records are split by the reader."""
    raw = spark.read.option("lineSep", RECORD).text(path).where(F.col("value") != "")
    lines = F.split("value", "\n")
    head = F.split(lines[0], FIELD)
    rows = raw.select(head[0].alias("commit"), F.timestamp_seconds(head[1].cast("long")).alias("time"), head[2].alias("author"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("l"))
    rows = rows.where("l <> ''").withColumn("f", F.split("l", "\t"))
    letters = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    letter = F.substring(F.col("f")[0], 1, 1)
    moved = letter.isin("R", "C")
    return rows.select(
        "commit", "time", "author", letters[letter].alias("status"), F.when(moved, F.col("f")[2]).otherwise(F.col("f")[1]).alias("path"),
        F.when(moved, F.col("f")[1]).alias("old_path"), F.when(moved, F.substring(F.col("f")[0], 2, 3).cast("int") * 10).alias("similarity"),
    )


def lineage(changes: DataFrame) -> DataFrame:
    """Relations (subject, predicate, object, confidence): what changed in which commit, and renames."""
    changed = changes.select(F.concat(F.lit("file:"), "path").alias("subject"), F.lit("changed_in").alias("predicate"), F.concat(F.lit("commit:"), "commit").alias("object"), F.lit(1000).alias("confidence"))
    renamed = changes.where("status = 'renamed'").select(F.concat(F.lit("file:"), "path"), F.lit("lineage_renamed_from"), F.concat(F.lit("file:"), "old_path"), "similarity")
    return changed.union(renamed)


def read_hunks(diffs: DataFrame) -> DataFrame:
    """(diff, path, start, end) of the hunks in unified diffs (diff, text): lines of the new file, end before start where none are left."""
    lines = diffs.select("diff", F.posexplode(F.split("text", "\r?\n")).alias("k", "line"))
    so_far = Window.partitionBy("diff").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    found = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.withColumn("path", F.last(F.when(found != "", found), True).over(so_far)).where(F.col("line").rlike(head))
    size = F.regexp_extract("line", head, 2)
    start = F.greatest(F.regexp_extract("line", head, 1).cast("int"), F.lit(1))
    return rows.select("diff", "path", start.alias("start"), (start + F.when(size == "", 1).otherwise(size.cast("int")) - 1).cast("int").alias("end")).where("path <> '/dev/null'")
