"""Exact nearest neighbours of many queries by cells, and vector tables that are checked before use."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.budget import VectorBinding
from ..runtime import materialize

#: The most vectors that cells are fitted on, those of least hash, and the most cells.
SAMPLE, CELLS = 16_384, 256
#: Rows of a cell, and queries, that one task compares.
ROWS, QUERIES = 8192, 2048


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite."""
    return F.coalesce(F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _unit(raw: list) -> np.ndarray:
    m = np.array(raw, np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m.reshape(0, 0)


def fit_cells(vectors: DataFrame, id_col: str, vector_col: str, seed: int = 42, rounds: int = 6) -> np.ndarray:
    """Unit centroids by spherical k-means on a bounded sample of the most frequent length; twice the root of the sample's size, ``CELLS`` at most."""
    sizes = vectors.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not sizes:
        return np.zeros((0, 0))
    sample = vectors.where(F.size(vector_col) == sizes["d"]).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector_col).toArrow()
    m = _unit(sample[vector_col].to_pylist())
    centres = m[np.random.default_rng(seed).permutation(len(m))[: max(1, min(CELLS, int(2 * len(m) ** 0.5), len(m)))]]
    for _ in range(rounds):
        own = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        n = np.linalg.norm(sums, axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centres)
    return centres


def _in_cells(rows: DataFrame, centres: np.ndarray, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, cell, angle): the cell of the nearest centroid and the angle to it; vectors of another length lie in cell -length, at any angle."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            cell = np.array([-len(v) for v in lists], np.int64)
            angle = np.full(len(lists), np.pi)
            fit = np.flatnonzero(cell == -centres.shape[1]) if len(centres) else np.zeros(0, np.int64)
            if len(fit):
                cos = _unit([lists[i] for i in fit]) @ centres.T
                cell[fit] = cos.argmax(1)
                angle[fit] = np.arccos(np.clip(cos.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.float64())), pa.array(cell), pa.array(angle)], ["id", "vector", "cell", "angle"])

    return rows.select(id_col, F.col(vector_col).cast("array<double>")).mapInArrow(run, f"id {id_type}, vector array<double>, cell long, angle double")


def _compared(rows: DataFrame, visits: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, seen): of each visit (query_id, vector, cell) the ``k`` best rows of each part of the cell, themselves left out.

    A cell's rows are dealt to parts of about ``ROWS``, its queries to parts of about ``QUERIES``, and a task
    compares a part of each. ``seen`` counts, on one row of each task's queries, the pairs compared.
    """
    asked = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_parts"))
    grid = parts.join(asked, "cell").select("cell", "parts", "q_parts")
    deal = lambda df, own, other, key: df.join(grid, "cell").select(
        "*", F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias("p_own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("p_other")
    )
    left = deal(rows, "parts", "q_parts", "id").select("id", "vector", "cell", F.col("p_own").alias("p"), F.col("p_other").alias("q"))
    right = deal(visits, "q_parts", "parts", "query_id").select("query_id", F.col("vector").alias("q_vector"), F.col("cell").alias("of_cell"), F.col("p_other").alias("of_p"), F.col("p_own").alias("of_q"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, q_ids = a["id"].to_numpy(), b["query_id"].to_numpy()
        out_q, out_i, out_s = [], [], []
        m = _unit(a["vector"].to_pylist())
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        for at in range(0, len(q_ids), 256):
            cos = np.clip(_unit(b["q_vector"].slice(at, 256).to_pylist()) @ m.T, -1, 1)
            score = np.floor(cos * 1e6 + 0.5) / 1e6
            own = q_ids[at : at + 256]
            score[own[:, None] == ids[None, :]] = -2
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids rise, so the least of equals comes first
            found = np.take_along_axis(score, top, 1)
            good = found > -2
            out_q.append(np.repeat(own, good.sum(1)))
            out_i.append(ids[top[good]])
            out_s.append(found[good])
        q, i, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, q_ids.dtype), (out_i, ids.dtype), (out_s, np.float64)))
        seen = np.zeros(len(q), np.int64)
        seen[:1] = len(ids) * len(q_ids)
        return pa.table([pa.array(q), pa.array(i), pa.array(s), pa.array(seen)], names=["query_id", "id", "score", "seen"])

    id_type = rows.schema["id"].dataType.simpleString()
    both = left.groupBy("cell", "p", "q").cogroup(right.groupBy("of_cell", "of_p", "of_q"))
    return both.applyInArrow(lambda a, b: best(a, b), f"query_id {id_type}, id {id_type}, score double, seen long")


def nearest_join(
    vectors: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", binding: tuple[VectorBinding, VectorBinding] | None = None
) -> DataFrame:
    """(query_id, id, score, rank): exact top-k by cosine of every query against all rows, itself left out; ties by id.

    Rows lie in cells around centroids that are fitted on a bounded sample. A query first meets the
    rows of its own cell; its k-th score there is an angle that a better row has to be within, and by
    the triangle inequality it then visits just the cells whose rows may be: those whose centroid is
    not farther than that angle and the cell's widest row together. Cells are compared in parts of
    bounded size. Only centroids, and a count and a width for each cell, pass through the driver.

    Vectors that are null, zero or not finite neither ask nor are found; a query meets rows of its own
    length alone. Ids are numbers. Equal ids ask once each. ``binding``: what the table was made from and what the
    queries were; they have to be the same.
    """
    if binding:
        binding[0].check(binding[1])
    spark = vectors.sparkSession
    good = vectors.where(usable(vector_col))
    centres = fit_cells(good, id_col, vector_col)
    rows = materialize(_in_cells(good, centres, id_col, vector_col), "nearest-rows")
    asking = materialize(_in_cells(queries.where(usable(vector_col)), centres, id_col, vector_col).withColumnRenamed("id", "query_id"), "nearest-queries")
    cells = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"), F.max("angle").alias("width"))
    cells = materialize(cells, "nearest-cells")
    parts = cells.select("cell", "parts")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = materialize(_compared(rows, asking.select("query_id", "vector", "cell"), parts, k), "nearest-first")
    reached = best(first.select("query_id", "id", "score")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    width = {r["cell"]: r["width"] for r in cells.where("cell >= 0").collect()}  # at most CELLS
    known = np.array(sorted(width), np.int64)
    at, wide = centres[known] if len(known) else np.zeros((0, 0)), np.array([width[c] for c in known.tolist()])
    id_type = asking.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = np.flatnonzero(batch.column("cell").to_numpy() >= 0)
            if not len(fit) or not len(known):
                continue
            cos = _unit(batch.column("vector").take(pa.array(fit)).to_pylist()) @ at.T
            need = batch.column("least").to_numpy(zero_copy_only=False)[fit]
            limit = np.arccos(np.clip(np.where(np.isnan(need), -1, need - 1e-6), -1, 1))
            near = np.arccos(np.clip(cos, -1, 1)) - wide <= limit[:, None] + 1e-7
            near &= known[None, :] != batch.column("cell").to_numpy()[fit][:, None]
            q, c = np.nonzero(near)
            src = pa.array(fit[q])
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(src), batch.column("vector").take(src), pa.array(known[c])], ["query_id", "vector", "cell"])

    least = asking.join(reached.withColumn("least", F.when(F.col("n") >= k, F.col("least"))), "query_id", "left").select("query_id", "vector", "cell", "least")
    visits = materialize(least.mapInArrow(run, f"query_id {id_type}, vector array<double>, cell long"), "nearest-visits")
    every = first.union(_compared(rows, visits, parts, k))
    return best(every.select("query_id", "id", "score").distinct()).select("query_id", "id", "score", "rank")


class ArtifactRejected(ValueError):
    pass


def _digest(vectors: DataFrame, id_col: str, vector_col: str) -> dict:
    """Rows and two order-free digests of ids and vectors."""
    one = F.xxhash64(id_col, vector_col)
    r = vectors.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(one).alias("x"), F.sum(F.xxhash64(F.lit("sum"), id_col, vector_col).cast("decimal(38,0)")).alias("s")).first()
    return {"rows": r["rows"], "digest": f"{r['x'] or 0}/{r['s'] or 0}"}


def write_artifact(vectors: DataFrame, path: str, binding: VectorBinding, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """A vector table with a manifest of its rows, digest and ``binding``."""
    vectors.write.parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    manifest = {"binding": binding.__dict__, "id": id_col, "vector": vector_col} | _digest(stored, id_col, vector_col)
    vectors.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_artifact(spark: SparkSession, path: str, binding: VectorBinding) -> DataFrame:
    """The table, if it is what its manifest says and was made from what ``binding`` names."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    VectorBinding(**manifest["binding"]).check(binding)
    found = spark.read.parquet(f"{path}/vectors")
    now = _digest(found, manifest["id"], manifest["vector"])
    wrong = [k for k in now if now[k] != manifest[k]]
    if wrong:
        raise ArtifactRejected(f"{path}: another {', '.join(wrong)} than its manifest has")
    return found
