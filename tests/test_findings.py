from collections import Counter
from itertools import combinations

from __spark_entry__ import queries
from loomgraph.sources import traces


def test_co_changes_counts_large_commits(spark):
    commits = {0: range(60), 1: range(60), 2: range(3)}
    rows = [(c, f"f{i:02}") for c, files in commits.items() for i in files]
    each = Counter(p for _, p in rows)
    together = Counter(pair for files in commits.values() for pair in combinations([f"f{i:02}" for i in files], 2))
    expected = {(a, b, n, n * 1000 // min(each[a], each[b])) for (a, b), n in together.items() if n >= 2}
    found = [tuple(r) for r in traces.co_changes(spark.createDataFrame(rows, "commit long, path string")).collect()]
    assert len(found) == len(expected) == 60 * 59 // 2 and set(found) == expected


def test_vector_join_takes_every_twentieth_vector(spark):
    got = queries()["vector_join"](spark, "/root/testdata/sf0.001").select("query_id").distinct()
    ids = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id")
    assert {r[0] for r in got.collect()} == {r[0] for r in ids.collect()}


def test_entry_lives_without_a_missing_module(monkeypatch):
    """If a module that the corpus operators need is not installed, the other queries are served."""
    import importlib
    import sys

    import __spark_entry__ as entry

    held = {n: sys.modules.pop(n) for n in list(sys.modules) if n.startswith("loomgraph.llm") or n == "corpus_pipeline"}
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    try:
        again = importlib.reload(entry)
        assert len(again.queries()) > 70 and not any(n.startswith("op") or n == "pipeline" for n in again.queries())
    finally:
        monkeypatch.undo()
        for n in [n for n in sys.modules if n.startswith("loomgraph.llm") or n == "corpus_pipeline"]:
            del sys.modules[n]
        sys.modules.update(held)
        importlib.reload(entry)


def test_no_machine_local_folder_on_a_cluster():
    import pytest

    from loomgraph import runtime

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
