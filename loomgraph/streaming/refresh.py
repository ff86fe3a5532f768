"""Refreshing a snapshot from a stream of scans: each micro-batch is diffed, never appended blindly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import file_transitions, reconcile_plan
from ..runtime import materialize
from ..sources.snapshots import SnapshotStore

FILE_COLUMNS = ("file", "path", "hash", "identity", "size", "mtime", "trusted")


def latest(batch: DataFrame) -> DataFrame:
    """The last scan of each file in a batch."""
    order = Window.partitionBy("file").orderBy(F.desc("mtime"), F.desc("hash"))
    return batch.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def apply_batch(store: SnapshotStore, batch: DataFrame, generation: str, full: bool = False) -> DataFrame:
    """Commit ``generation`` as the active snapshot with the batch's files applied; returns their transitions.

    Scans are matched with all files of the active snapshot, so a file that comes back under another
    id is a move, not an addition. A file is deleted by a scan whose ``deleted`` (optional) is true, or,
    with ``full``, by being absent. The other tables are carried; the transitions say whose facts are
    to be extracted anew. A batch that was applied before (a replay after a failure) changes nothing; one
    that was committed by a job that died before it was made active is made active now.
    """
    committed = generation in store.generations()
    if committed and store.was_active(generation):
        return batch.sparkSession.createDataFrame([], "file string, previous_file string, change string")
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    scans = materialize(latest(batch.select(*FILE_COLUMNS, deleted.alias("deleted"))), "refresh-scan")
    scan, gone = scans.where("NOT deleted").select(*FILE_COLUMNS), scans.where("deleted").select("file")
    active = store.active()
    known = bool(active) and "files" in store.tables(active)
    base = store.read("files").withColumnRenamed("id", "file").select(*FILE_COLUMNS) if known else scan.limit(0)
    matches = materialize(reconcile_plan(base.join(gone, "file", "left_anti"), scan).where("previous_file IS NOT NULL").select("file", "previous_file"), "refresh-matches")
    met = matches.select(F.col("previous_file").alias("file"))
    touched = base if full else base.join(met.union(gone).distinct(), "file", "left_semi")
    changes = materialize(file_transitions(touched, scan, matches), "refresh-changes")
    if committed:
        store.activate(generation)
        return changes
    files = scan if full else scan.unionByName(base.join(met, "file", "left_anti").join(gone, "file", "left_anti"))
    store.stage(generation, {"files": files.withColumnRenamed("file", "id")}, carry_from=active)
    store.commit(generation)
    return changes


def refresh(
    stream: DataFrame,
    store: SnapshotStore,
    checkpoint: str,
    on_changes: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    full: bool = False,
) -> StreamingQuery:
    """Start a query that applies each micro-batch as a generation; exactly once, as generations are named by query and batch.

    The query's name is that of its checkpoint, so a second stream into the same store, or one begun
    anew, makes generations of its own.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        query = store.json(f"{checkpoint.rstrip('/')}/metadata")["id"]
        changes = apply_batch(store, batch, f"g{query}-{batch_id:08d}", full)
        if on_changes:
            on_changes(changes, batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str, late: str) -> DataFrame:
    """(start, key, n, value): tumbling counts of a stream or a table, late rows accepted for ``late``."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time_col, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("start"), key, "n", "value")
