import collections
import json
import random

import pyarrow as pa
import pytest

from loomgraph.llm import substring_dedup
from loomgraph.llm.substring_dedup import FingerprintIndex, _kept_text, dedup_substrings, remove_repeats

from . import brute

COLS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def counted(df, *cols):
    return collections.Counter(map(tuple, df.select(*cols).collect()))


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)


def test_batches_join_history(spark, monkeypatch):
    """The hits that are verified come from joins of each batch with the older runs."""
    made = []
    init = FingerprintIndex.__init__
    monkeypatch.setattr(FingerprintIndex, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    added = []
    add = FingerprintIndex.add
    monkeypatch.setattr(FingerprintIndex, "add", lambda self, fps: added.append(1) or add(self, fps))
    rows = brute.corpus(n=60)
    got = counted(dedup_substrings(frame(spark, rows), batches=3), *COLS)
    assert got == collections.Counter((r[0], *x) for r, x in zip(rows, brute.substring([r[1] for r in rows])))
    assert len(added) == 3 and made[0].merged == 2 and made[0].compacted == 1  # the first two are one run when the third comes
    # Without hits only what is found three times in one Arrow batch goes: they are what decides.
    monkeypatch.setattr(FingerprintIndex, "add", lambda self, fps: add(self, fps).limit(0))
    pairs = [(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"a{i}" for i in range(60)))]
    assert {r["n_removed"] for r in dedup_substrings(frame(spark, pairs)).collect()} == {0}


def test_later_calls_meet_earlier_ones(spark, tmp_path):
    """Three calls on one stored index, opened anew each time: each judges its documents against all so far."""
    rows = brute.corpus(seed=3, n=90)
    parts = [rows[:60], rows[60:100], rows[100:]]
    path = str(tmp_path / "index")
    before = []
    compacted = 0
    for part in parts:
        index = FingerprintIndex(spark, path, buckets=3, fan_in=3)
        got = counted(dedup_substrings(frame(spark, part), index=index), *COLS)
        texts = [r[1] for r in before + part]
        want = brute.substring(texts)[len(before) :]
        assert got == collections.Counter((r[0], *x) for r, x in zip(part, want))
        before += part
        compacted += index.compacted
    again = FingerprintIndex(spark, path)
    assert compacted >= 2 and len(again.runs) < 3 and len(again.batches) == 3 and again.buckets == 3
    rows_of_runs = sum(again._run(r).count() for r in again.runs)
    assert rows_of_runs > 0
    manifests = sorted(p.name for p in (tmp_path / "index" / "manifests").iterdir() if p.name.endswith(".json") and p.name[0] != ".")
    assert manifests == [f"{i:09d}.json" for i in (1, 2, 3)]
    assert set(json.loads((tmp_path / "index" / "manifests" / manifests[-1]).read_text())["runs"]) == set(again.runs)
    # A passage of the first call alone, seen again: all of it goes.
    passage = " ".join(f"p{i}" for i in range(50))
    dedup_substrings(frame(spark, [(1, passage)]), index=FingerprintIndex(spark, path)).count()
    out = dedup_substrings(frame(spark, [(2, f"new {passage} words")]), index=FingerprintIndex(spark, path)).collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in out] == [(52, 50, "new words")]
    again.drop()
    assert not (tmp_path / "index").exists()


def test_uncommitted_runs_are_not_read(spark, tmp_path):
    index = FingerprintIndex(spark, str(tmp_path / "index"), buckets=2)
    fps = spark.createDataFrame([(1,), (1,), (2,)], "fp long")
    assert {r[0] for r in index.add(fps).collect()} == {1}
    assert {r[0] for r in index.add(spark.createDataFrame([(2,), (3,)], "fp long")).collect()} == {2}
    assert FingerprintIndex(spark, str(tmp_path / "index")).runs == []
    index.compact()
    assert {tuple(r) for r in index._run(index.runs[0]).collect()} == {(1, 2), (2, 2), (3, 1)}


@pytest.mark.parametrize("extra", ["k", "j", "s", "at", "fp", "d", "e", "n", "s2"])
def test_clashing_columns(spark, extra):
    text = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 7), (2, text, 8), (3, None, 9)], f"doc_id long, text string, {extra} int")
    out = remove_repeats(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {(1, "", 7), (2, "", 8), (3, None, 9)}


def test_kept_text_keeps_lines():
    text = b"  one two\n\tthree  four\nfive six \n"
    assert _kept_text(text, [False] * 6) == b"  one two\n\tthree  four\nfive six"
    assert _kept_text(text, [False, True, True, False, False, True]) == b"  one\nfour\nfive"
    assert _kept_text(text, [True, True, False, False, False, False]) == b"three  four\nfive six"
    assert _kept_text(text, [False, False, False, True, False, False]) == b"  one two\n\tthree\nfive six"
    assert _kept_text(text, [True] * 6) == b""


def test_hot_text_is_dealt(spark):
    """Copies of one text meet their verdict in several parts."""
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(64)], "doc_id long, text string").repartition(8)
    assert substring_dedup.SALT > 1
    assert {(r["n_words"], r["n_removed"]) for r in dedup_substrings(df).collect()} == {(60, 60)}


def test_an_index_is_of_one_window(spark, tmp_path):
    """Asked for windows of another length it refuses, rather than miss what they share."""
    path, text = str(tmp_path / "index"), " ".join(f"a{i}" for i in range(60))
    dedup_substrings(frame(spark, [(1, text)]), index=FingerprintIndex(spark, path)).count()
    with pytest.raises(ValueError, match="35-word windows, not of 20"):
        dedup_substrings(frame(spark, [(2, text)]), window=20, index=FingerprintIndex(spark, path))


def test_the_query_compacts_before_its_last_batch(spark, monkeypatch):
    made, init = [], FingerprintIndex.__init__
    monkeypatch.setattr(FingerprintIndex, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    rows = brute.corpus(seed=5, n=40)
    got = counted(dedup_substrings(frame(spark, rows)), *COLS)
    assert got == collections.Counter((r[0], *x) for r, x in zip(rows, brute.substring([r[1] for r in rows])))
    assert made[0].compacted == 1 and made[0].merged == 2


def test_history_is_neither_shuffled_nor_read_whole(spark, tmp_path):
    """Blocks of earlier calls are joined in their buckets; of their texts only folders with a hit are read."""
    path = str(tmp_path / "index")
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(200)]
    dedup_substrings(frame(spark, texts), index=FingerprintIndex(spark, path, buckets=3)).count()
    index = FingerprintIndex(spark, path)
    plan = index.blocks_of(spark.createDataFrame([(5,)], "fp long"))[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 3 out of 3" in plan
    keys = spark.createDataFrame([(5,)], "k long")
    assert 0 < index.texts_of(keys).count() < 30


def test_verdicts_for_batches_of_any_order(spark, monkeypatch):
    """A passage of one window in 60 documents, none else of their words alike: each goes, though rows come in another order whenever they are read."""
    rng, windows = random.Random(5), substring_dedup._windows

    def shuffled(texts, window):
        def run(batches):
            table = pa.Table.from_batches(batches)
            if table.num_rows:
                yield from table.take(random.SystemRandom().sample(range(table.num_rows), table.num_rows)).combine_chunks().to_batches()

        return windows(texts.mapInArrow(run, texts.schema), window)

    monkeypatch.setattr(substring_dedup, "_windows", shuffled)
    say = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    passages = [say(35), say(36)]
    rows = [(i, f"{say(rng.randrange(40))} {passages[i % 2]} {say(rng.randrange(40))}") for i in range(120)] + [(120, say(80))]
    for _ in range(3):
        got = counted(dedup_substrings(frame(spark, rows)), *COLS)
        assert got == collections.Counter((r[0], *x) for r, x in zip(rows, brute.substring([r[1] for r in rows])))
