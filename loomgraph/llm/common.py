"""Shared plumbing: Arrow kernels, shared-folder tables, distributed ranks, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, shared_dir

Kernel = Callable[[pa.RecordBatch], pa.RecordBatch]


#: What one cache of a Python worker may hold, keys and values with their overhead.
CACHE_BYTES = 160 << 20
_ENTRY_BYTES = 120


class BoundedCache(dict):
    """A dict that computes missing entries; of two generations, together ``limit`` bytes, the older one goes as a whole."""

    def __init__(self, make: Callable, limit: int = CACHE_BYTES):
        super().__init__()
        self._make, self._half, self._old, self._used = make, limit // 2, {}, 0

    def __missing__(self, key):
        value = self._old.pop(key, None)
        if value is None:
            value = self._make(key)
        size = _ENTRY_BYTES + getsizeof(key) + getsizeof(value)
        if type(value) is list:
            size += sum(map(getsizeof, value))
        if size > self._half:  # one entry alone would push out all others
            return value
        if self._used + size > self._half:
            self._old, self._used = dict(self), 0
            self.clear()
        self._used += size
        self[key] = value
        return value


#: Batches sent to Python workers hold no more than this, or one row; a worker holds a few copies of one.
BATCH_BYTES = 8 << 20
_held: dict = {}
_asked = [0]


def held(key: tuple, make: Callable):
    """``make()``, kept by the Python worker until it runs another operator."""
    _asked[0] += 1
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def own_kernel(make_kernel: Callable):
    """``make_kernel()``; unless it holds something itself, what an earlier operator held goes first."""
    before = _asked[0]
    kernel = make_kernel()
    if _asked[0] == before:
        _held.clear()
    return kernel


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's batches to Python workers by ``BATCH_BYTES``.

    The bound is read when the plan runs, so it has to stay in the session; a smaller one is left as it is.
    """
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, make_kernel: Callable[[], Kernel], schema: str) -> DataFrame:
    """``mapInArrow`` with one kernel per task, over batches bounded by bytes, not by rows alone."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = own_kernel(make_kernel)
        for batch in batches:
            if batch.num_rows:
                yield kernel(batch)

    return df.mapInArrow(run, schema)


def own_dir(spark: SparkSession) -> str:
    """The application's folder below the shared one, as ``materialize`` uses it and ``runtime.clear`` deletes it."""
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` whose readers have all run."""
    path = getattr(df, "_loomgraph_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def distributed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the row's 0-based rank within ``keys`` by (bucket, order), and ``out_n``: rows of the key.

    ``bucket`` cuts each key into ordered buckets of a fixed number, so that a key with a third of
    all rows is ranked by many tasks: a window numbers the rows inside a bucket, and bucket sizes,
    summed map-side, give where each bucket begins. Only the small table of sizes meets per key.
    """
    b = "__rank_b"
    rows = df.withColumn(b, bucket)
    sizes = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__rank_n"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        F.col(b).alias("__s_b"),
        F.coalesce(F.sum("__rank_n").over(before), F.lit(0)).alias("__rank_start"),
        F.sum("__rank_n").over(by_key).alias(f"{out}_n"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1
    on = F.col(b).eqNullSafe(F.col("__s_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    joined = rows.withColumn("__rank_local", local).join(starts, on)
    return joined.withColumn(out, F.col("__rank_start") + F.col("__rank_local")).drop(
        b, "__s_b", "__rank_local", "__rank_start", *[f"__s_{k}" for k in keys]
    )


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), component being its smallest node.

    Alternating large-star and small-star steps: each links every neighbour to the smallest node of
    its neighbourhood, by an aggregate (combined map-side) and a join, until nothing changes. Work
    a round is linear in the edges; hubs are split by the skew join. A table in the shared folder
    cuts the lineage after each round. Nothing is collected but a checksum of the edges.
    """

    def distinct_min(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = materialize(distinct_min(edges), f"{label}-edges")
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        after = materialize(distinct_min(small), f"{label}-edges")
        release(now)
        now, was = after, seen
        seen = mark(now)
        if seen == was:
            break
    else:
        raise RuntimeError("components did not settle")
    # Every edge is now a star: (node, its component).
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
