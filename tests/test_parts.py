import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import PatternRejected, code_tokens, fold, folded, route_key, safe_pattern, token_column
from loomgraph.operators import evidence, incremental, resolve, retrieval, vectors, workspace
from loomgraph.plans import batch, budget, completeness, paging
from loomgraph.sources import files, history, indexing, reads, scip, snapshots, syntax, traces
from loomgraph.streaming import refresh


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("HTTPServer", ["http", "server"]),
        ("crate::HTTP2Server/path.rs", ["crate", "http", "2", "server", "path", "rs"]),
        ("snake_case42", ["snake", "case", "42"]),
        ("Straße", ["strasse"]),
        ("caféBar", ["café", "bar"]),
        ("", []),
    ],
)
def test_tokens(text, tokens):
    assert code_tokens(text) == tokens


def test_fold(spark):
    assert fold("Straße") == fold("STRASSE") and fold("ς") == fold("σ") and fold("é") == fold("é")
    df = spark.createDataFrame([("STRASSE",), (None,), ("Straße",)], "t string")
    assert rows(df.select(folded("t"))) == {("strasse",), (None,)}
    assert df.select(token_column("t")).collect()[0][0] == ["strasse"]
    texts = ["HTTPServer", "crate::HTTP2Server/path.rs", "snake_case42", "Straße", "caféBar", "cafe\u0301Bar\u0301Baz", "ΣΑΣ", "X1Y", "aB中文C", "", "__", "parseHTMLDoc2x"]
    for text, got in df.sparkSession.createDataFrame([(t,) for t in texts], "t string").select("t", token_column("t")).collect():
        assert [fold(t) for t in got] == code_tokens(text), text


def test_patterns():
    assert safe_pattern("ab.c*", False) == "^ab.c*$" and safe_pattern("src/*.rs", True) == r"^src/.*\.rs$"
    for text, glob in ((".ab", False), ("*ab", True), ("a*", True), ("ab**", True), ("ab(", False), ("ab?????", True), ("ab*", False), ("a.b", False)):
        with pytest.raises(PatternRejected):
            safe_pattern(text, glob)


def test_route_key(spark):
    df = spark.createDataFrame([("get", "/a//{id}/:x/b"), ("GET", "/a/../b"), ("GET", "http://x"), ("G1", "/a"), ("post", "/"), ("GET", "/a?b")], "m string, p string")
    assert [r[0] for r in df.select(route_key(F.col("m"), F.col("p"))).collect()] == ["GET /a/{}/{}/b", None, None, None, "POST /", None]


def test_locate_order(spark):
    e = [("a", "test", "run", "x.run"), ("b", "function", "runner", "x.runner"), ("c", "function", "run", "x.run"), ("d", "interface", "run", "y.run")]
    df = spark.createDataFrame([(i, k, n, q, None, "public", "A", "rust", f"src/{i}.rs") for i, k, n, q in e], "id string, kind string, name string, qualified_name string, container_id string, visibility string, tier string, language string, path string")
    docs = retrieval.lexical_documents(df)
    assert [r["id"] for r in retrieval.locate(docs, "prefix", "run").collect()] == ["c", "d", "a", "b"]
    assert [r["id"] for r in retrieval.locate(docs, "prefix", "run", limit=2, offset=1).collect()] == ["d", "a"]
    assert retrieval.locate(docs, "exact", "run", ["go"]).count() == 0
    assert [r["id"] for r in retrieval.locate(docs, "exact", "RUN").collect()] == ["c", "d", "a"]


def test_text_search_scores(spark):
    """Classes come before scores; within one, more and rarer tokens and names before paths."""
    e = [("a", "parse", "x.parse", "src/http/parse.rs"), ("b", "httpParse", "x.httpParse", "src/b.rs"), ("c", "parseHTTPHead", "x.c", "src/c.rs"), ("d", "other", "x.other", "http/parse/d.rs"), ("s", "Straße", "x.s", "s.rs")]
    df = spark.createDataFrame([(i, "function", n, q, None, "public", "A", "rust", p) for i, n, q, p in e], "id string, kind string, name string, qualified_name string, container_id string, visibility string, tier string, language string, path string")
    docs = retrieval.lexical_documents(df)
    stored = retrieval.lexical_postings(docs).cache()
    got = retrieval.locate(docs, "text", "HTTP parse", postings=stored).collect()
    assert {r["id"] for r in got} == {"a", "b", "c", "d"} and all(r["score"] > 0 for r in got)
    order = [r["id"] for r in got]
    assert order.index("b") < order.index("d") and order.index("c") < order.index("d")
    assert [r["id"] for r in retrieval.locate(docs, "text", "http/parse", postings=stored).collect()][0] == "d"  # a path that begins so
    assert [r["id"] for r in retrieval.locate(docs, "text", "STRASSE").collect()] == ["s"]
    own = {(r["id"], r["field"], r["term"], r["tf"]) for r in stored.collect()}
    assert ("c", "name", "http", 1) in own and ("d", "path", "parse", 1) in own


def test_nearest_rejects(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in retrieval.nearest(v, [1.0, 0.0]).collect()] == [(1, 1.0), (6, 1.0)]
    with pytest.raises(ValueError):
        retrieval.nearest(v, [0.0, 0.0])
    one = budget.VectorBinding("r", "g", "m", "h", "c")
    assert retrieval.nearest(v, [1.0, 0.0], binding=(one, one)).count() == 2
    other = budget.VectorBinding("r", "g2", "m", "h", "c")
    for search in (lambda: retrieval.nearest(v, [1.0, 0.0], binding=(one, other)), lambda: vectors.nearest_join(v, v, binding=(one, other))):
        with pytest.raises(ValueError, match="generation"):
            search()


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.active() is None and store.generations() == []
    e = spark.createDataFrame([("a",), ("b",)], "id string")
    r = spark.createDataFrame([("r", "a", "b")], "id string, subject string, object string")
    store.stage("g1", {"entities": e, "relations": r})
    assert store.generations() == []
    store.commit("g1")
    store.stage("g2", {"entities": e.limit(1), "relations": r})
    with pytest.raises(snapshots.SnapshotError):
        store.commit("g2")
    store.rollback("g2")
    store.stage("g2", {"entities": e.union(spark.createDataFrame([("c",)], "id string"))})
    store.commit("g2")
    assert store.active() == "g2" and store.read("entities").count() == 3 and store.read("entities", "g1").count() == 2
    with pytest.raises(snapshots.SnapshotError):
        store.remove("g2")
    store.export_bundle("g1", str(tmp_path / "bundle"))
    store.remove("g1")
    assert store.import_bundle(str(tmp_path / "bundle")) == "g1" and store.active() == "g2"
    assert store.read("relations", "g1").count() == 1


def test_pages_and_cursors(spark):
    df = spark.range(10)
    first = paging.page(df, "id", 4)
    assert first.total == 10 and first.truncated and first.last == 3
    last = paging.page(df, "id", 4, 7)
    assert [r[0] for r in last.rows.collect()] == [8, 9] and not last.truncated
    assert paging.page(df, "id", 4, 99).last is None
    bound = {"tool": "locate", "snapshot": "g1"}
    cursor = paging.issue_cursor(bound, 3, b"k", now=0)
    assert paging.open_cursor(cursor, bound, b"k", now=1) == 3
    for bad, binding, key, now, why in ((cursor, bound, b"x", 1, "tampered"), (cursor, {"tool": "x"}, b"k", 1, "other_query"), (cursor, bound, b"k", 10**6, "expired"), ("A" + cursor[1:], bound, b"k", 1, "tampered")):
        with pytest.raises(paging.CursorRejected, match=why):
            paging.open_cursor(bad, binding, key, now=now)


def test_batch(spark):
    def fail(_):
        raise ValueError("no")

    ops = [batch.Operation("c", lambda f: f["a"].where("id > 1"), ("a",)), batch.Operation("a", lambda f: spark.range(4)), batch.Operation("b", fail), batch.Operation("d", lambda f: f["b"], ("b",))]
    out = batch.run(ops)
    assert rows(batch.summary(out)) == {("a", 4), ("c", 2)} and out.failed == {"b": "no"} and out.skipped == ["d"]
    for bad in ([batch.Operation("a", fail, ("b",)), batch.Operation("b", fail, ("a",))], [batch.Operation("a", fail, ("z",))], [batch.Operation(str(i), fail) for i in range(17)]):
        with pytest.raises(batch.BatchRejected):
            batch.order(bad)


def test_claims(spark):
    df = spark.createDataFrame([("negative", "complete", "complete"), ("negative", "truncated", "complete"), ("ranking", None, "complete"), ("aggregate", "complete", "sampled")], "k string, s string, c string")
    got = [r[0] for r in df.select(completeness.claim_disposition(F.col("k"), F.col("s"), F.col("c"))).collect()]
    assert got == ["supported", "inconclusive", "qualified", "inconclusive"]


def test_traces(spark):
    trace = {"schema": "1.0", "repository": "r", "generation": "g", "records": [{"kind": "calls", "subject": "a", "object": "b", "count": 2}] * 2}
    texts = spark.createDataFrame([(json.dumps(trace),)], "value string")
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    records = traces.parse_traces(texts)
    assert rows(traces.import_trace(records, known)) == {("calls", "a", "b", 2)}
    with pytest.raises(traces.TraceRejected, match="unknown"):
        traces.import_trace(records, known.limit(1))
    with pytest.raises(traces.TraceRejected, match="conflicting"):
        traces.import_trace(records.union(spark.createDataFrame([("calls", "a", "b", 3)], records.schema)), known)
    with pytest.raises(traces.TraceRejected, match="malformed"):
        traces.parse_traces(spark.createDataFrame([("{nope",)], "value string"))


def test_renames_and_spans(spark):
    c = spark.createDataFrame([("k1", "old.py", "deleted", "h1"), ("k1", "new.py", "added", "h1"), ("k1", "x.py", "added", "h2")], "commit string, path string, status string, content_hash string")
    assert rows(traces.renames(c)) == {("k1", "old.py", "new.py", 1000)}
    f = spark.createDataFrame([("f", "héllo\nworld")], "file string, text string")
    good = f.select(F.sha2("text", 256)).first()[0]
    spans = spark.createDataFrame([("f", 0, 3, good), ("f", 0, 3, "x"), ("f", 5, 99, good), ("g", 0, 1, good)], "file string, start_byte long, end_byte long, content_hash string")
    assert {(r["content"], r["status"]) for r in files.read_spans(f, spans).collect()} == {("hé", "ok"), (None, "stale_hash"), (None, "invalid_span"), (None, "missing_file")}
    lines = files.read_lines(f.withColumnRenamed("file", "id"), "id", F.col("text"), F.lit(2), F.lit(2), 5, 5)
    assert rows(lines) == {("f", 1, "héllo"), ("f", 2, "world")}


def test_discovery_and_syntax(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "lib.py").write_text("import os\ndef main():\n    helper(1)\n\ndef helper(x):\n    return x\n")
    (tmp_path / "src" / "note.txt").write_text("x")
    found = files.discover(spark, str(tmp_path), exclude=(r"\.txt$",))
    assert [(r["language"], r["class"]) for r in found.collect()] == [("python", "source")]
    src = spark.createDataFrame([("lib.py", "python", (tmp_path / "src" / "lib.py").read_text())], "path string, language string, text string")
    assert rows(syntax.declarations(src).select("name", "kind", "line")) == {("main", "function", 2), ("helper", "function", 5)}
    assert rows(syntax.uses(src).select("role", "text", "line")) == {("call_site", "helper", 3), ("import_use", "os", 1)}


def greedy(c, objective, budget):
    return evidence.select_pack(pd.DataFrame(c), objective, budget)


def test_pack_reserves_roles_and_limits_sources():
    base = {"pack": "p", "relevance": 1, "confidence": 1, "anchor": False}
    c = [{**base, "position": i + 1, "id": f"i{i}", "role": "definition", "tokens": 10, "path": "same", "provider": f"v{i}", "region": i} for i in range(4)]
    c.append({**base, "position": 5, "id": "arch", "role": "architecture", "tokens": 60, "path": "z", "provider": "z", "region": 0})
    out = greedy(c, "explanation", 90).set_index("id")["outcome"].to_dict()
    assert out == {"i0": "selected", "i1": "selected", "i2": "diversity", "i3": "diversity", "arch": "selected"}
    tight = greedy(c, "explanation", 75).set_index("id")["outcome"].to_dict()
    assert tight["arch"] == "selected" and tight["i1"] == "budget"


def test_resolution_cases(spark):
    e = spark.createDataFrame(
        [("outer", "module", "outer", "outer", None, "A", "rust", "f1"), ("x1", "function", "go", "outer.go", "outer", "A", "rust", "f1"), ("x2", "function", "go", "other.go", "z", "A", "rust", "f2"), ("x3", "constant", "go", "c.go", None, "A", "rust", "f3"), ("y", "function", "go", "p.go", None, "A", "python", "f4")],
        "id string, kind string, name string, qualified_name string, container_id string, tier string, language string, path string",
    )
    o = spark.createDataFrame(
        [("o1", "reference", "go", "rust", "A", "f9", "outer", "x"), ("o2", "call_site", "go", "rust", "A", "f2", None, "x"), ("o3", "import_use", "lib", "rust", "A", "f1", None, "x"), ("o4", "type_use", "go", "rust", "A", "f1", None, "x"), ("o5", "call_site", "other.go", "rust", "A", "f5", None, "r.scoped_call")],
        "id string, role string, text string, language string, tier string, file string, enclosing string, syntax_kind string",
    )
    found = resolve.candidates(o, e)
    score = {(r["occurrence"], r["symbol"]): r["score"] for r in found.rows.collect()}
    assert score["o1", "x1"] == 940 and score["o1", "x2"] == 500 and score["o1", "x3"] == 550
    assert score["o2", "x2"] == 899 and score["o5", "x2"] == 900
    d = {r["occurrence"]: r for r in resolve.decide(o, found).collect()}
    assert d["o1"]["outcome"] == "resolved" and d["o1"]["symbols"] == ["x1"]
    assert d["o2"]["outcome"] == "candidates" and d["o2"]["symbols"] == ["x2", "x1"]
    assert (d["o3"]["outcome"], d["o3"]["reason"]) == ("unresolved", "missing_dependency")
    assert d["o4"]["reason"] == "unsupported_target_kind" and d["o5"]["outcome"] == "resolved"
    rel = rows(resolve.derive_relations(resolve.decide(o, found), found).select("subject", "predicate", "object"))
    assert ("o1", "refers_to", "x1") in rel and ("o2", "dispatch_candidate", "x1") in rel and ("o5", "calls", "x2") in rel


def test_invalidation_falls_back(spark):
    changes = spark.createDataFrame([("k1",), ("k2",)], "key string")
    edges = spark.createDataFrame([("k1", "n1")], "key string, node string")
    facts = spark.createDataFrame([("n1", "n2"), ("n3", "n4")], "subject string, object string")
    out = rows(incremental.invalidation(changes, edges, facts))
    assert out == {(n, "missing_dependency_declaration") for n in ("n1", "n2", "n3", "n4")}
    assert rows(incremental.invalidation(changes.limit(1), edges, facts)) == {("n1", "input"), ("n2", "fact")}
    assert {r[1] for r in rows(incremental.invalidation(changes.limit(1), edges, facts, max_work=0))} == {"closure_work_exceeded"}


def test_links(spark):
    d = [("p1", "A", "provider"), ("p2", "B", "provider"), ("p3", "C", "provider"), ("c1", "A", "consumer"), ("c2", "D", "consumer")]
    df = spark.createDataFrame([(i, r, w, "http", "GET /", 900, []) for i, r, w in d] + [("c3", "A", "consumer", "http", "GET /none", 1, [])], "id string, repository string, direction string, kind string, key string, confidence int, caveats array<string>")
    out = rows(workspace.link_overlay(df, 2).select("consumer", "provider", "caveats", "candidate_count"))
    assert out == {("c1", "p2", "multiple_candidates", 2), ("c1", "p3", "multiple_candidates", 2), ("c2", "p1", "candidate_limit,multiple_candidates", 3), ("c2", "p2", "candidate_limit,multiple_candidates", 3)}
    assert rows(workspace.unresolved_consumers(df)) == {("c3",)}


def test_stream_refresh(spark, tmp_path):
    schema = "file string, path string, hash string, identity string, size long, mtime long, trusted boolean"
    source = str(tmp_path / "scans")
    spark.createDataFrame([("f1", "a.py", "h1", "i1", 1, 1, True), ("f2", "b.py", "h2", "i2", 1, 1, True)], schema).write.parquet(source)
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    seen = []
    keep = lambda df, b: seen.append(rows(df.select("file", "change")))
    run = lambda: refresh.refresh(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "ck"), keep).awaitTermination()
    run()
    spark.createDataFrame([("f1", "a.py", "h9", "i1", 2, 2, True), ("f1", "a.py", "h8", "i1", 2, 1, True), ("f3", "c.py", "h3", "i3", 1, 1, True)], schema).write.mode("append").parquet(source)
    run()
    assert seen == [{("f1", "added"), ("f2", "added")}, {("f1", "modified"), ("f3", "added")}]
    assert rows(store.read("files").select("id", "hash")) == {("f1", "h9"), ("f2", "h2"), ("f3", "h3")}


SCAN = "file string, path string, hash string, identity string, size long, mtime long, trusted boolean"


def test_refresh_carries_moves_and_deletes(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    scans = lambda *r, schema=SCAN: spark.createDataFrame([(f, p, h, i, 1, t, True, *more) for f, p, h, i, t, *more in r], schema)
    e = spark.createDataFrame([("a",), ("b",)], "id string")
    files_ = scans(("f1", "a.py", "h1", "i1", 1), ("f2", "b.py", "h2", "i2", 1), ("f3", "c.py", "h3", "i3", 1))
    store.stage("g0", {"entities": e, "files": files_.withColumnRenamed("file", "id")})
    store.commit("g0")
    got = refresh.apply_batch(store, scans(("f9", "z.py", "h1", "i1", 2)), "g1")
    assert rows(got) == {("f9", "f1", "moved")}
    assert rows(store.read("entities")) == {("a",), ("b",)} and rows(store.read("files").select("id")) == {("f9",), ("f2",), ("f3",)}
    got = refresh.apply_batch(store, scans(("f2", "b.py", None, None, 3, True), ("f4", "d.py", "h4", "i4", 3, False), schema=f"{SCAN}, deleted boolean"), "g2")
    assert rows(got) == {(None, "f2", "deleted"), ("f4", None, "added")}
    assert rows(refresh.apply_batch(store, scans(("f4", "d.py", "h4", "i4", 3)), "g2")) == set()
    got = refresh.apply_batch(store, scans(("f4", "d.py", "h5", "i4", 4)), "g3", full=True)
    assert rows(got) == {("f4", "f4", "modified"), (None, "f3", "deleted"), (None, "f9", "deleted")}
    assert store.active() == "g3" and store.read("entities").count() == 2 and rows(store.read("files").select("id")) == {("f4",)}
    with pytest.raises(snapshots.SnapshotError, match="carry"):
        store.remove("g0")
    store.remove("g1")
    store.export_bundle("g3", str(tmp_path / "bundle"))
    other = snapshots.SnapshotStore(spark, str(tmp_path / "other"))
    assert other.import_bundle(str(tmp_path / "bundle")) == "g3" and other.read("entities", "g3").count() == 2


def test_activation_never_leaves_a_gap(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    for g in ("g1", "g2"):
        store.stage(g, {"files": spark.createDataFrame([(g,)], "id string")})
        store.commit(g)
    assert store.active() == "g2"
    (tmp_path / "store" / "active" / "new-lost").write_text("{")  # what a job leaves that died before its rename
    assert store.active() == "g2"
    store.activate("g1")
    assert store.active() == "g1" and len(store._pointers()) == 3


def test_pairs_do_not_cancel_in_digests(spark):
    a, b = (spark.createDataFrame([(x,), (x,)], "v string") for x in "ab")
    assert [r["equal"] for r in incremental.equivalence({"d": a}, {"d": b}).collect()] == [False]
    assert [r["equal"] for r in incremental.equivalence({"d": a}, {"d": a}).collect()] == [True]


def test_invalidation_follows_long_chains(spark):
    facts = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "subject string, object string")
    out = incremental.invalidation(spark.createDataFrame([("k",)], "key string"), spark.createDataFrame([("k", "n0")], "key string, node string"), facts)
    assert len(rows(out)) == 71


def test_discovery_counts_and_ignores(spark, tmp_path):
    for name, text in (("src/a.py", "x"), ("src/big.py", "y" * 100), ("build/out.py", "x"), ("src/gen/keep.py", "x"), ("src/gen/drop.py", "x"), ("note.log", "x"), ("deep/x/note.log", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("# output\n/build/\n*.log\nsrc/gen/*\n!src/gen/keep.py\n")
    found = {r["path"].split(f"{tmp_path.name}/")[1]: (r["status"], r["content_hash"] is None) for r in files.discover(spark, str(tmp_path), max_bytes=50).collect()}
    assert found == {"src/a.py": ("eligible", False), "src/big.py": ("too_large", True), "src/gen/keep.py": ("eligible", False)}
    assert {r["path"][-4:] for r in files.discover(spark, str(tmp_path), ignore=("src/",)).collect()} == set()


def test_large_index_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "index.scip").write_bytes(b"\x12\x00" * 40)
    monkeypatch.setattr(scip, "MAX_INDEX_BYTES", 50)
    with pytest.raises(scip.ScipRejected, match="over 50 bytes"):
        scip.read_scip(spark, str(tmp_path / "index.scip"))


def test_packs_over_their_bound_are_refused(spark):
    c = spark.createDataFrame([("p", str(i), "definition", 1, 1, 10, "a", "b", 1, False) for i in range(5)], "pack string, id string, role string, relevance int, confidence int, tokens long, path string, provider string, region int, anchor boolean")
    assert evidence.pack_evidence(c, "bug_fix", 100).count() == 5
    with pytest.raises(budget.BudgetExceeded, match="candidates"):
        evidence.pack_evidence(c, "bug_fix", 100, bounds=budget.Budget(candidates=4))


def test_completeness_of_many_parts(spark):
    parts = spark.createDataFrame([("k", "complete", [], "not_applicable"), ("k", "truncated", ["rows", "edges"], "available"), ("k", "truncated", ["rows"], "unavailable"), ("e", "complete", None, "not_applicable")], "key string, state string, limiting array<string>, continuation string")
    assert rows(completeness.merge(parts, "key")) == {("k", "truncated", "edges,rows", "unavailable"), ("e", "complete", "", "not_applicable")}


def test_stream_windows(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS k, 1.5D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT TIMESTAMP '2024-01-01 03:00:00', 'b', 1.0D").write.parquet(path)
    stream = refresh.windowed_counts(spark.readStream.schema("ts timestamp, k string, value double").parquet(path), "ts", "k", "1 hour", "10 minutes")
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch_rows = rows(refresh.windowed_counts(spark.read.parquet(path), "ts", "k", "1 hour", "10 minutes"))
    assert rows(spark.table("w")) == batch_rows and len(batch_rows) == 2


def test_scip_round_trip(spark, tmp_path):
    documents = [
        {"path": "a.py", "language": "python", "occurrences": [{"symbol": "s a", "roles": 1, "range": [0, 4, 9]}, {"symbol": "s b", "roles": 8, "range": [300, 1, 2, 3]}],
         "symbols": [{"symbol": "s a", "name": "a", "kind": 17, "enclosing": "", "relationships": [{"symbol": "s b", "kind": "implementation"}]}]},
        {"path": "b.py", "language": "python", "occurrences": [], "symbols": [{"symbol": "s b", "name": "", "kind": 0, "enclosing": "s a", "relationships": []}]},
    ]
    df = spark.createDataFrame([tuple(d.values()) for d in documents], scip.SCHEMA)
    index = tmp_path / "index.scip"
    index.write_bytes(scip.export_index(df, str(tmp_path / "parts")))
    back = scip.read_scip(spark, str(index))
    assert sorted((r.asDict(True) for r in back.collect()), key=lambda d: d["path"]) == documents
    entities, occurrences, relations = scip.to_facts(back)
    assert rows(entities.select("id", "name", "container_id")) == {("s a", "a", None), ("s b", "", "s a")}
    assert rows(occurrences.select("role", "symbol", "line")) == {("definition", "s a", 0), ("read", "s b", 300)}
    assert rows(relations) == {("s a", "implements", "s b", 1000)}
    with pytest.raises(scip.ScipRejected):
        list(scip.fields(b"\x0a\x05ab"))


def test_history(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x1eh1\x1f0\x1fann\n\nA\ta.py\nM\tb.py\n\x1eh2\x1f60\x1fbob\n\nR090\ta.py\tc.py\n\x1eh3\x1f61\x1fbob\n")
    found = history.read_log(spark, str(log))
    assert rows(found.select("commit", "status", "path", "old_path", "similarity")) == {("h1", "added", "a.py", None, None), ("h1", "modified", "b.py", None, None), ("h2", "renamed", "c.py", "a.py", 900)}
    assert ("file:c.py", "lineage_renamed_from", "file:a.py", 900) in rows(history.lineage(found))


def test_budgets(spark):
    assert budget.guard(spark.range(5), "results", budget.Budget(results=5)).count() == 5
    with pytest.raises(budget.BudgetExceeded):
        budget.guard(spark.range(6), "results", budget.Budget(results=5))
    a = budget.VectorBinding("r", "g", "m", "h", "c")
    a.check(a)
    with pytest.raises(ValueError, match="generation"):
        a.check(budget.VectorBinding("r", "g2", "m", "h", "c"))


def test_index_repository(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "lib.py").write_text("import os\ndef main():\n    helper(1)\n\ndef helper(x):\n    return x\n")
    (src / "app.py").write_text("import lib\ndef run():\n    unknown(2)\n")
    (src / "note.txt").write_text("x")
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    indexing.index_repository(spark, str(src), store, "g1")
    assert rows(indexing.status(store)) == {("g1", 3, 2, 1, "bounded")}
    names = {r["name"] for r in store.read("entities").where("kind = 'function'").collect()}
    assert names == {"main", "helper", "run"}
    calls = store.read("relations").where("predicate = 'calls'")
    assert [("#main@2" in r["subject"], "#helper@5" in r["object"]) for r in calls.collect()] == [(True, True)]
    one = store.read("files").select("id").first()[0]
    assert reads.point(store.read("files"), one).count() == 1
    every = store.read("relations")
    anchor = calls.first()["subject"].split("#")[0]
    assert reads.relation_range(every, anchor, "outgoing", ["contains"], limit=1).count() == 2
    assert reads.coverage_range(store.read("coverage"), "language", "python").count() == 1
    with pytest.raises(ValueError):
        reads.relation_range(every, anchor, "outgoing", [], limit=1)


SOURCES = {
    "pkg/base.py": "class Base:\n    pass\n",
    "pkg/app.py": "from pkg.base import Base\nclass App(Base):\n    def run(self, b: Base):\n        return start(b)\n",
    "web/shape.ts": "export interface Shape {\n}\nexport class Root {\n}\n",
    "web/square.ts": "import { Shape } from './shape'\nexport class Square extends Root implements Shape {\n}\napp.get('/squares/:id', list)\n",
    "core/lib.rs": "pub trait Draw {\n}\npub struct Pen;\nimpl Draw for Pen {\n}\n",
    "j/A.java": "public class A extends B implements C {\n    public int size(int x) {\n        return go(x);\n    }\n}\n",
    "j/B.java": "public class B {\n}\ninterface C {\n}\n",
    "n/x.cpp": "class Node : public Tree {\n};\nint walk(int a) {\n",
    "n/t.cpp": "class Tree {\n};\n",
    "c/S.cs": "namespace N {\n  public class Sharp : Base9 {\n    public void Go() {\n",
    "r/r.rb": "class Dog < Animal\n  def bark\nend\nclass Animal\nend\n",
    "p/p.php": "class P extends Q {\n  public function hi() {\n}\nclass Q {\n}\n",
    "g/g.go": "type Reader interface {\n}\nfunc Open(x int) {\n",
    "c/c.c": "struct point {\nint add(int a, int b) {\n",
}


def test_eleven_languages_bind_across_files(spark, tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    store = snapshots.SnapshotStore(spark, str(tmp_path) + "-store")
    indexing.index_repository(spark, str(tmp_path), store, "g1")
    short = lambda i: i.split("#")[1].split("@")[0] if "#" in i else i.split("/")[-1]
    edges = {(short(r["subject"]), r["predicate"], short(r["object"])) for r in store.read("relations").collect()}
    want = {("App", "extends", "Base"), ("Square", "extends", "Root"), ("Square", "implements", "Shape"), ("Pen", "implements", "Draw"), ("A", "extends", "B"), ("A", "implements", "C"), ("Node", "extends", "Tree"), ("Dog", "extends", "Animal"), ("P", "extends", "Q")}
    assert want <= edges
    assert {("app.py", "imports", "base.py"), ("square.ts", "imports", "shape.ts"), ("run", "uses_type", "Base"), ("square.ts", "serves_route", "{}")} <= edges
    kinds = {(r["name"], r["kind"]) for r in store.read("entities").collect()}
    assert {("Shape", "interface"), ("Draw", "trait"), ("size", "method"), ("walk", "function"), ("Sharp", "class"), ("N", "namespace"), ("bark", "method"), ("hi", "method"), ("Reader", "interface"), ("point", "struct"), ("add", "method"), ("GET /squares/{}", "route")} <= kinds


def test_catalog_pages(spark):
    from loomgraph.sources.catalog import list_catalog

    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate([("beta", "ready"), ("Alpha", "ready"), ("Straße", "stale"), ("gamma", "ready"), ("alpha", "stale")])], "id long, name string, state string")
    page = lambda **k: [tuple(r) for r in list_catalog(df, **k).orderBy("position").collect()]
    assert page(limit=2) == [(1, 1, "Alpha", "ready", 5, True), (2, 4, "alpha", "stale", 5, True)]
    assert [r[1] for r in page(limit=3, after=("alpha", 4))] == [0, 3, 2] and not page(limit=3, after=("alpha", 4))[0][5]
    assert page(search=("STRASSE",)) == [(1, 2, "Straße", "stale", 1, False)]
    assert [r[1] for r in page(states=("ready",))] == [1, 0, 3] and page(search=("nothing",)) == []


def test_written_tables_can_be_cleared(spark):
    from loomgraph import runtime

    df = runtime.materialize(spark.range(3), "x")
    assert df.count() == 3
    runtime.clear(spark)
    assert runtime.materialize(spark.range(2), "x").count() == 2


def test_postings_are_counted_in_their_row(spark):
    """no aggregate over rows, whose table grew with a task's part of the input."""
    rows = [("a", "ring ring small", "x.ring", "a/b/a"), ("b", None, "", "--"), ("c", "B2b b B", "z", None)]
    documents = spark.createDataFrame(rows, "id string, name string, qualified_name string, path string")
    found = retrieval.lexical_postings(documents)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    got = {(r["id"], r["field"], r["term"]): (r["tf"], r["length"]) for r in found.collect()}
    assert len(got) == found.count() and got == {
        ("a", "name", "ring"): (2, 3), ("a", "name", "small"): (1, 3), ("a", "qualified_name", "x"): (1, 2), ("a", "qualified_name", "ring"): (1, 2), ("a", "path", "a"): (2, 3), ("a", "path", "b"): (1, 3),
        ("c", "name", "b"): (4, 5), ("c", "name", "2"): (1, 5), ("c", "qualified_name", "z"): (1, 1),
    }
