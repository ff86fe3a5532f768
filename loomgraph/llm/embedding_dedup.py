"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: A label of n distinct vectors has about CELLS_FACTOR * sqrt(n) cells.
CELLS_FACTOR = 2
#: A label's centroids are fitted on about so many vectors a cell, those of least hash, and on no more than MOST_SAMPLE
#: in all; beyond MOST_SAMPLE / SAMPLE_A_CELL cells it has no more of them, and its blocks grow in number instead.
SAMPLE_A_CELL, MOST_SAMPLE = 16, 1 << 18
#: Parts that the rows of one label are dealt to where they meet what is known of it.
DEAL = 16
#: Rows of one side of a product.
BLOCK_ROWS = 4096
_STRIP = 256
#: Slack on angles, far above rounding errors.
_EPS = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Unit centroids of unit vectors ``x``; an empty cell takes a vector at random."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-12
        sums[lost] = x[rng.integers(0, len(x), lost.sum())]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors from under- or overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visits(x: np.ndarray, centroids: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's home) of unit vectors ``x``: the nearest centroid's cell, and each later
    cell that may be home to a vector within angle ``theta``.

    All that is at home in cell j lies beyond the great circle that parts it from the own cell i; the
    angle from x to that circle is asin(x (c_i - c_j) / |c_i - c_j|).
    """
    dot = x @ centroids.T
    home = dot.argmax(axis=1)
    own = dot[np.arange(len(x)), home]
    if theta < math.pi / 2:
        apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
        near = own[:, None] - dot <= math.sin(theta) * apart[home] + _EPS
    else:
        near = np.ones_like(dot, bool)
    near &= np.arange(len(centroids))[None, :] >= home[:, None]
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot = lambda p, q: math.fsum((p * q).tolist())
    return dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b))


def _compare(rows: pa.Table, threshold: float) -> pa.Table:
    """Of one task's rows: each linked vertex with the weight of its partners and its least local vertex.

    Output is one row for each vertex at most, never a row for each pair.
    """
    rows = rows.combine_chunks()
    side = rows["side"].to_numpy()
    member = rows["member"].to_numpy(zero_copy_only=False)
    ids, weight = rows["v"].to_numpy(), rows["m"].to_numpy()
    x = _unit(_matrix(rows["embedding"].chunk(0)))
    both = (side == 0).all()
    on_left = np.flatnonzero(side == 0)
    on_right = on_left if both else np.flatnonzero(side == 1)
    # Two visitors meet in another cell, so only members meet all: left ones, and right ones what is left over.
    meet = [(on_left[member[on_left]], on_right)]
    if not both:
        meet.append((on_left[~member[on_left]], on_right[member[on_right]]))
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for left, right in meet:
        for k in range(0, len(left), _STRIP):
            strip = left[k : k + _STRIP]
            cos = x[strip] @ x[right].T
            hit = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):
                hit[i, j] = _exact(x[strip[i]], x[right[j]]) >= threshold
            hit &= strip[:, None] != right[None, :]
            links[strip] += hit @ weight[right]
            # What a member sees on its own side sees it too, unless that is a member as well and has its own turn.
            back = hit if not both else hit & ~member[right][None, :]
            links[right] += weight[strip] @ back
            for i in np.flatnonzero(hit.any(axis=1)):
                met = np.unique(label[np.append(right[hit[i]], strip[i])])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    on = links > 0
    return pa.table({"v": ids[on], "n": links[on], "root": least[label][on]})


def embedding_groups(
    df: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cells: int | None = None,
) -> DataFrame:
    """One row per vector: n_links, component_id (smallest id reachable by links), kept (id = component_id).

    Vectors of one label link at cosine ``threshold`` or more. Equal vectors are one vertex with a
    weight. Each label has its own cells, about twice the root of its vectors. A vertex goes to the
    cell of its nearest centroid, and as a visitor to the later cells that ``visits`` does not rule
    out: no link is lost, however cells fall. A cell's rows are cut into blocks, a task compares two
    blocks, and emits a row for each vertex at most.

    No links, component of its own, kept: a vector that is null, empty, all zero or holds null or
    non-finite components, or whose label is null. Vectors of different lengths, of which there may be
    any number, don't link. Very long vectors are compared whole. Null ids: never name a component that holds another. Repeated rows link as copies. Empty table: no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    finite = "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')"
    fit = F.expr(
        f"label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, {finite}) "
        "AND exists(embedding, x -> x <> 0)"
    )
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    vertices = rows.where("fit").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first"))
    vertices = materialize(vertices.withColumn("v", F.monotonically_increasing_id()), "embedding-vertices")

    linked = _linked(vertices, threshold, cells)
    comps = connected_components(linked.select(F.col("v").alias("u"), F.col("root").alias("v")), "embedding")
    partners = linked.groupBy("v").agg(F.sum("n").alias("n"))
    named = (
        vertices.join(comps, vertices["v"] == comps["node"], "left")
        .join(partners, "v", "left")
        .select("label", "embedding", "first", F.coalesce("component", "v").alias("c"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    )
    firsts = named.groupBy("c").agg(F.min("first").alias("component_id"))
    known = named.join(firsts, "c").select("label", "embedding", "n_links", "component_id")
    good = rows.where("fit").join(known, ["label", "embedding"]).select("id", "n_links", "component_id")
    rest = rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def dealt_to_cells(vertices: DataFrame, threshold: float, cells: int | None = None) -> DataFrame:
    """(label, d, cell, member, v, m, embedding): each vertex at home and where it visits, by label and vector length ``d``.

    The rows of a label are dealt by hash to blocks of bounded size, and each block meets a copy of
    the label's centroids; nothing of it passes through the driver.
    """
    theta = math.acos(max(-1.0, min(1.0, threshold))) + _EPS
    kinds = dict(vertices.dtypes)
    rows = vertices.withColumns({"d": F.size("embedding"), "s": F.expr(f"CAST(pmod(xxhash64(v), {DEAL}) AS INT)")})
    most = MOST_SAMPLE // SAMPLE_A_CELL
    sizes = rows.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n"))
    k = F.lit(cells) if cells else F.least(F.lit(most), F.ceil(CELLS_FACTOR * F.sqrt("n")))
    sizes = sizes.select("label", "d", "n", F.least("n", k).cast("int").alias("k"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("nb"))
    # A label of a third of all rows meets its size in DEAL parts.
    spread = sizes.withColumn("s", F.explode(F.expr(f"sequence(0, {DEAL - 1})")))
    known = rows.join(spread, ["label", "d", "s"]).withColumn("b", F.expr("CAST(pmod(xxhash64(v, 7L), nb) AS INT)"))
    share = F.col("k") * SAMPLE_A_CELL / F.col("n")
    sample = known.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 31)) < share * (1 << 31)).select("label", "d", "k", "v", "embedding")

    def fit(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("v").slice(0, MOST_SAMPLE).combine_chunks()
        found = spherical_kmeans(_unit(_matrix(part["embedding"].chunk(0))), part["k"][0].as_py())
        n = len(found)
        flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
        return pa.table([pa.array([key[0].as_py()] * n, part.schema.field("label").type), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), flat], names=["label", "d", "cell", "centroid"])

    fitted = sample.groupBy("label", "d").applyInArrow(fit, f"label {kinds['label']}, d int, cell int, centroid array<double>")
    fitted = materialize(fitted, "embedding-centroids")
    blocks = fitted.join(sizes, ["label", "d"]).withColumn("b", F.explode(F.expr("sequence(0, nb - 1)"))).select("label", "d", "b", "cell", "centroid")

    def assign(key: tuple, part: pa.Table, centres: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        if not part.num_rows or not centres.num_rows:  # no sample, then one cell holds all
            row = np.arange(part.num_rows)
            cell, member = np.zeros(len(row), np.int64), np.ones(len(row), bool)
        else:
            centres = centres.sort_by("cell").combine_chunks()
            row, cell, member = visits(_unit(_matrix(part["embedding"].chunk(0))), _matrix(centres["centroid"].chunk(0)), theta)
        return part.take(pa.array(row)).append_column("cell", pa.array(cell.astype(np.int32))).append_column("member", pa.array(member))

    left = known.select("label", "d", "b", "v", "m", "embedding").groupBy("label", "d", "b")
    schema = f"label {kinds['label']}, d int, b int, v long, m long, embedding {kinds['embedding']}, cell int, member boolean"
    return left.cogroup(blocks.groupBy("label", "d", "b")).applyInArrow(assign, schema).drop("b")


def _linked(vertices: DataFrame, threshold: float, cells: int | None) -> DataFrame:
    """(v, n, root) of the tasks that compare blocks."""
    dealt = materialize(dealt_to_cells(vertices, threshold, cells), "embedding-cells")
    blocks = dealt.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nb"))
    # A cell of a third of all rows, copies nearly, meets its count in DEAL parts.
    spread = blocks.withColumn("s", F.explode(F.expr(f"sequence(0, {DEAL - 1})")))
    parts = dealt.withColumn("s", F.expr(f"CAST(pmod(xxhash64(v), {DEAL}) AS INT)"))
    placed = parts.join(spread, ["label", "d", "cell", "s"]).withColumn("b", F.expr("CAST(pmod(xxhash64(v), nb) AS INT)"))
    tasks = placed.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "label",
        "d",
        "cell",
        F.least("b", "o").alias("i"),
        F.greatest("b", "o").alias("j"),
        F.expr("CASE WHEN b <= o THEN 0 ELSE 1 END").alias("side"),
        "member",
        "v",
        "m",
        "embedding",
    )

    def compare(rows: pa.Table) -> pa.Table:
        return _compare(rows, threshold)

    found = tasks.groupBy("label", "d", "cell", "i", "j").applyInArrow(compare, "v long, n long, root long")
    return materialize(found, "embedding-links")


def representatives(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", **options) -> DataFrame:
    """Ids of the rows that stay: the smallest of each group."""
    return embedding_groups(df, threshold, id_col=id_col, **options).where("kept").select(id_col)
