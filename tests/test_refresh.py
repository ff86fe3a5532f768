"""Facts replaced file by file, against a clean index; refreshes after a crash and by a second stream."""

import shutil

import pytest

from loomgraph.operators import incremental
from loomgraph.sources import indexing, snapshots
from loomgraph.streaming import refresh

from .test_calls import FILES

rows = lambda df: {tuple(r) for r in df.collect()}


def write(root, files):
    for name, text in files.items():
        path = root / name
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)


def same_as_clean(spark, root, store, tmp_path, label):
    clean = snapshots.SnapshotStore(spark, str(tmp_path / f"clean-{label}"))
    indexing.index_repository(spark, str(root), clean, "g")
    domains = lambda s: {t: s.read(t).select(*sorted(c for c in s.read(t).columns if not c.endswith("_at"))) for t in ("files", "entities", "occurrences", "relations", "bindings", "routes", "coverage")}
    found = {r["domain"]: r for r in incremental.equivalence(domains(store), domains(clean)).collect()}
    assert {d for d, r in found.items() if not r["equal"]} == set(), label
    assert found["relations"]["n_clean"] > 20


def test_refresh_is_a_clean_index(spark, tmp_path, monkeypatch):
    """After edits, moves, deletions and additions the merged facts are those of an index made anew."""
    monkeypatch.setattr(snapshots.SnapshotStore, "MOST_PARTS", 2)
    root = tmp_path / "src"
    write(root, FILES | {"web/r.js": "app.get('/x', list)\n", "py/sub/deep.py": "from lib import helper\ndef deep():\n    helper()\n"})
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    indexing.index_repository(spark, str(root), store, "g0")
    first = rows(store.read("relations").select("id"))
    assert rows(indexing.refresh_repository(spark, str(root), store, "g1")) == set() and store.active() == "g0"
    steps = [
        {"py/lib.py": "\n\n" + FILES["py/lib.py"].replace("def other", "def another"), "src/service.rs": None, "src/core/service.rs": FILES["src/service.rs"], "web/b.js": "export function draw(x) {\n}\n"},
        {"web/s.js": "app.get('/x', list)\napp.post('/y', list)\n", "web/r.js": None, "go/a/y.go": None, "py/other/lib.py": "def helper():\n  return 2\n", "py/app.py": FILES["py/app.py"] + "\ndef more():\n    main()\n"},
        {"py/other/lib.py": None, "web/b.js": FILES["web/b.js"], "go/a/y.go": FILES["go/a/y.go"]},
    ]
    for k, step in enumerate(steps):
        write(root, step)
        changes = indexing.refresh_repository(spark, str(root), store, f"g{k + 1}")
        assert changes.count() == len(step) and store.active() == f"g{k + 1}"
        same_as_clean(spark, root, store, tmp_path, k)
    parts = store._parts("g3")
    assert len(parts["entities"]["generations"]) < 4 and parts["relations"]["owner"] == "relations_at"
    assert rows(store.read("relations", "g0").select("id")) == first
    with pytest.raises(snapshots.SnapshotError, match="parts"):
        store.remove(parts["entities"]["generations"][0])


def test_only_touched_files_are_extracted(spark, tmp_path):
    """A refresh writes the facts of changed files, and relations of those and of files that spell their names."""
    root = tmp_path / "src"
    write(root, {f"m{k}.py": f"def f{k}():\n    f{k}()\n    g{k}()\n" for k in range(12)} | {"use.py": "import m3\ndef u():\n    m3.f3()\n"})
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    indexing.index_repository(spark, str(root), store, "g0")
    write(root, {"m3.py": "def f3():\n    pass\n"})
    indexing.refresh_repository(spark, str(root), store, "g1")
    at = lambda t: {p.rsplit("/", 1)[1] for (p,) in rows(spark.read.parquet(str(tmp_path / "store" / "generations" / "g1" / f"{t}.part")).select("file"))}
    assert at("entities") == {"m3.py"} and at("relations") == {"m3.py", "use.py"}


SCAN = "file string, path string, hash string, identity string, size long, mtime long, trusted boolean"


def test_replay_after_a_crash_loses_no_batch(spark, tmp_path, monkeypatch):
    """A job that dies between commit and activation: its replay makes the batch active and tells its changes."""
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    batch = lambda f: spark.createDataFrame([(f, f"{f}.py", "h", f, 1, 1, True)], SCAN)
    refresh.apply_batch(store, batch("f1"), "g1")
    with monkeypatch.context() as m:
        m.setattr(snapshots.SnapshotStore, "activate", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            refresh.apply_batch(store, batch("f2"), "g2")
    assert store.active() == "g1"
    assert rows(refresh.apply_batch(store, batch("f2"), "g2")) == {("f2", None, "added")}
    refresh.apply_batch(store, batch("f3"), "g3")
    assert rows(store.read("files").select("id")) == {("f1",), ("f2",), ("f3",)}
    assert rows(refresh.apply_batch(store, batch("f2"), "g2")) == set() and store.active() == "g3"


def test_second_stream_into_one_store(spark, tmp_path):
    """Another checkpoint begins at batch 0 again; its batches are generations of their own."""
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    for k in (1, 2):
        source = str(tmp_path / f"scans{k}")
        spark.createDataFrame([(f"f{k}", f"{k}.py", "h", f"i{k}", 1, 1, True)], SCAN).write.parquet(source)
        refresh.refresh(spark.readStream.schema(SCAN).parquet(source), store, str(tmp_path / f"ck{k}")).awaitTermination()
    assert rows(store.read("files").select("id")) == {("f1",), ("f2",)} and len(store.generations()) == 2
    shutil.rmtree(tmp_path / "ck1")
