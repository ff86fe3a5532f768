"""The neighbour join against all pairs, and vector tables that are not what they were."""

import numpy as np
import pytest

from loomgraph.operators import vectors
from loomgraph.plans.budget import VectorBinding

V = "vec_id long, embedding array<float>"


def plain(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, v in queries:
        if not v or None in v or not np.isfinite(v).all() or not any(v):
            continue
        a = np.array(v, np.float64)
        scores = [(-(np.floor(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1) * 1e6 + 0.5) / 1e6), i) for i, b in good if i != q and len(b) == len(a)]
        out |= {(q, i, round(-s, 6), r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_join_is_that_of_all_pairs(spark, monkeypatch, spread):
    """Clustered vectors and scattered ones, in small parts; bad vectors, other lengths, copies."""
    monkeypatch.setattr(vectors, "ROWS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "CELLS", 12)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + spread * rng.normal(size=6)]) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [1.0, 2.0]), (405, [2.0, 1.0]), (460, [3.0, 1.0]), *[(500 + i, rows[7][1]) for i in range(60)]]
    df = spark.createDataFrame(rows, V).repartition(3)
    queries = [r for r in rows if r[0] % 20 == 0]
    got = {tuple(r) for r in vectors.nearest_join(df, df.where("vec_id % 20 = 0")).collect()}
    assert {(q, i, round(s, 6), r) for q, i, s, r in got} == plain(rows, queries, 3)
    assert vectors.nearest_join(df, df.where("vec_id < 0")).count() == 0
    assert vectors.nearest_join(df.limit(0), df.where("vec_id < 60")).count() == 0


def test_cells_are_skipped(spark, monkeypatch):
    """On clustered vectors most pairs are never compared."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.05 * rng.normal(size=32)]) for i in range(2000)]
    df = spark.createDataFrame(rows, V)
    seen = []
    compared = vectors._compared
    monkeypatch.setattr(vectors, "_compared", lambda *a: seen.append(compared(*a)) or seen[-1])
    assert vectors.nearest_join(df, df.where("vec_id % 20 = 0")).count() == 300
    assert sum(s.agg({"seen": "sum"}).first()[0] or 0 for s in seen) < 0.3 * 100 * 2000


def test_artifact_is_verified(spark, tmp_path):
    one = VectorBinding("r", "g1", "m", "h", "c")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], V)
    path = str(tmp_path / "a")
    vectors.write_artifact(df, path, one)
    assert vectors.read_artifact(spark, path, one).count() == 2
    with pytest.raises(ValueError, match="generation"):
        vectors.read_artifact(spark, path, VectorBinding("r", "g2", "m", "h", "c"))
    df.limit(1).write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(vectors.ArtifactRejected, match="rows"):
        vectors.read_artifact(spark, path, one)


def test_join_takes_all_queries(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.uniform(-1, 1, 4)]) for i in range(1100)], "vec_id long, embedding array<double>")
    assert vectors.nearest_join(df.limit(5), df).select("query_id").distinct().count() == 1100
