"""The stored inverted index against the search without one."""

import random

import pytest

from loomgraph.operators import retrieval
from loomgraph.plans.budget import BudgetExceeded
from loomgraph.sources.snapshots import SnapshotStore

E = "id string, kind string, name string, qualified_name string, container_id string, tier string, language string, path string, documentation string"
WORDS = ["parse", "http", "server", "row", "open", "close", "ring", "small"]


def entities(rng, files):
    rows = []
    for f in files:
        for k in range(rng.randrange(1, 9)):
            name = "_".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
            doc = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 4, 30])))
            rows.append((f"{f}#{k}", rng.choice(["function", "function", "test", "trait"]), name, f"m.{name}", None, "A", "go" if f.endswith("3") else "rust", f, doc))
    return rows


def stage(spark, store, generation, docs, all_files, at, carry_from=None):
    files = spark.createDataFrame([(f, f, at[f]) for f in all_files], "id string, path string, index_at string")
    parts = {n: (df, "index_at") for n, df in retrieval.LexicalIndex.tables(docs, 8).items()}
    store.stage(generation, {"files": files}, retrieval.LexicalIndex.PARTITIONS, carry_from, parts)
    store.commit(generation)
    return retrieval.LexicalIndex(*[store.read(n) for n in ("postings", "maxima", "lengths")], 8)


def test_same_hits_after_updates(spark, tmp_path, monkeypatch):
    """Hits, order and scores are those of the plain search, before and after files change, come and go, whatever is pruned."""
    monkeypatch.setattr(retrieval, "FIRST_BLOCKS", 5)
    rng = random.Random(9)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    files = [f"src/f{k}" for k in range(60)]
    rows = entities(rng, files)
    at = dict.fromkeys(files, "g0")
    docs = retrieval.lexical_documents(spark.createDataFrame(rows, E))
    index = stage(spark, store, "g0", docs, files, at)

    def check(queries):
        for query, kwargs in queries:
            plain = retrieval.locate(docs, "text", query, **kwargs).collect()
            assert retrieval.locate(docs, "text", query, index=index, **kwargs).collect() == plain and plain

    check([("parse", {}), ("http row", {"limit": 3}), ("ring small", {"limit": 4, "offset": 5}), ("row", {"languages": ["go"], "limit": 2})])
    changed, gone = files[:7], files[7:10]
    files = [f for f in files if f not in gone] + ["src/new"]
    fresh = entities(rng, [*changed, "src/new"])
    rows = [r for r in rows if r[7] not in {*changed, *gone}] + fresh
    at = {f: "g1" if f in {*changed, "src/new"} else "g0" for f in files}
    index = stage(spark, store, "g1", retrieval.lexical_documents(spark.createDataFrame(fresh, E)), files, at, "g0")
    docs = retrieval.lexical_documents(spark.createDataFrame(rows, E))
    check([("parse", {"limit": 5}), ("small open", {}), ("ring", {"limit": 1})])


def test_reads_only_the_terms_folders_and_fails_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "FIRST_BLOCKS", 5)
    rng = random.Random(4)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    files = [f"src/f{k}" for k in range(80)]
    docs = retrieval.lexical_documents(spark.createDataFrame(entities(rng, files), E))
    index = stage(spark, store, "g0", docs, files, dict.fromkeys(files, "g0"))
    plan = index._of(index.postings, ["ring"], None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "EqualTo(term,ring)" in plan.replace(" ", "")
    with pytest.raises(BudgetExceeded, match="postings"):
        retrieval.locate(docs, "text", "ring", index=index, max_postings=3).collect()
    # Most blocks can't reach a page of one: their postings are not read.
    all_of = index._of(index.postings, ["ring"], None).count()
    found = retrieval.locate(docs, "text", "ring row", limit=1, index=index, max_postings=all_of).collect()
    assert found == retrieval.locate(docs, "text", "ring row", limit=1).collect()


def test_a_term_of_all_documents_is_written_by_several_tasks(spark):
    """postings of one term, a third of all, were sorted by one task."""
    e = spark.range(4000).selectExpr("concat('part:', id) id", "'function' kind", "'ring' name", "'ring' qualified_name", "CAST(NULL AS STRING) container_id", "'public' visibility", "'C' tier", "'b' language", "concat('part/', id) path")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        made = retrieval.LexicalIndex.tables(retrieval.lexical_documents(e))["postings"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.where("term = 'ring'").count() == 8000
    assert made.where("term = 'ring'").select(retrieval.F.input_file_name()).distinct().count() > 1
