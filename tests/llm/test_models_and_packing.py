import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import packing
from loomgraph.llm.classifier import Settings, fit, score_documents, train_on
from loomgraph.llm.embedding_dedup import embedding_groups, representatives
from loomgraph.llm.packing import best_fit, pack_documents

from . import brute

WORD = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int, n long, root long, v long, cell int"


def vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    rows = []
    for i in range(300):
        x = centres[rng.integers(30)] + rng.normal(size=dim) * rng.choice([0.01, 0.1, 0.15, 0.5])
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(3)) if i % 17 else None))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] + [1.0] * (dim - 1), 1), (2003, [None] + [1.0] * (dim - 1), 1)]
    rows += [(2004, [float("inf")] * dim, 1), (2005, [], 1), (2006, [1.0, 0.0], 1), (2007, [-0.0, 1.0], 1), (2008, [0.0, 1.0], 1)]
    rows += [rows[3], (None, rows[5][1], rows[5][2]), (None, None, None)]
    return [(*r, 9, 9, 9, 9) for r in rows]


def expected_groups(rows):
    def fit_(r):
        x = r[1]
        return r[2] is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)

    def linked(i, j):
        a, b = rows[i], rows[j]
        if not (fit_(a) and fit_(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        dot = lambda p, q: sum(x * y for x, y in zip(p, q))
        return dot(a[1], b[1]) / math.sqrt(dot(a[1], a[1]) * dot(b[1], b[1])) >= 0.98

    n = len(rows)
    on = {(i, j) for i in range(n) for j in range(i + 1, n) if linked(i, j)}
    roots = brute.components(list(range(n)), lambda i, j: (i, j) in on)
    links, least = collections.Counter(k for p in on for k in p), {}
    for r, c in zip(rows, roots):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return collections.Counter((r[0], links[i], least.get(roots[i]), r[0] == least.get(roots[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize(("cells", "block"), [(None, 4096), (7, 4096), (3, 16)])
def test_embedding_groups(spark, monkeypatch, cells, block):
    from loomgraph.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = collections.Counter(map(tuple, embedding_groups(df, cells=cells).collect()))
    assert got == expected_groups(rows)


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_groups(empty).count() == 0
    assert representatives(spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], "vec_id long, embedding array<float>, label int")).count() == 1


def test_embedding_many_lengths(spark):
    rows = [(i, [1.0] * (1 + i // 2), 0) for i in range(160)]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 1, i // 2 * 2) for i in range(160)}


def test_cells_save_comparisons(spark):
    """Every label has several cells, and what their rows compare is a small share of all pairs."""
    import os

    from loomgraph.llm.embedding_dedup import dealt_to_cells

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    t = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS v", "1L AS m", "label", "embedding")
    cells, all_pairs, pairs = collections.defaultdict(collections.Counter), 0, 0
    for r in dealt_to_cells(t, 0.98).collect():
        cells[r["label"]][r["cell"], r["member"]] += 1
    for counts in cells.values():
        n = sum(c for (_, member), c in counts.items() if member)
        all_pairs += n * (n - 1) // 2
        homes = {cell: c for (cell, member), c in counts.items() if member}
        assert len(homes) > 1
        pairs += sum(c * (c - 1) // 2 + c * counts[cell, False] for cell, c in homes.items())
    assert pairs < 0.25 * all_pairs


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SWEEP_ROWS", 40)
    library = Tokenizer.from_file(WORD)
    rows = brute.corpus()
    df = spark.createDataFrame(rows, brute.DOC_SCHEMA).repartition(3)
    got = pack_documents(df, WORD, capacity=200, with_ids=True).collect()
    want = collections.Counter()
    total = 0
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), 200):
            part = ids[k : k + 200]
            want[(r[0], k // 200, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    assert check_packed(got, 200) <= math.ceil(total / 200) * 1.1 + 1
    assert pack_documents(spark.createDataFrame([], brute.DOC_SCHEMA), WORD).count() == 0


@pytest.mark.parametrize("rows", [200, 16_384])
def test_rounds_near_best_fit(spark, monkeypatch, rows):
    """Several rounds of several tasks use hardly more sequences than best-fit decreasing, piece by piece."""
    monkeypatch.setattr(packing, "SWEEP_ROWS", rows)
    ran = []
    each = packing._round
    monkeypatch.setattr(packing, "_round", lambda p, g, tasks, *more: ran.append(tasks) or each(p, g, tasks, *more))
    rng = random.Random(4)
    for capacity in (100, 4096, 64):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 8)) for _ in range(3000)]
        ran.clear()
        out = best_fit(spark.createDataFrame(list(enumerate(lengths)), "p_key long, p_length long"), capacity).collect()
        assert sorted(r["p_key"] for r in out) == list(range(3000))
        assert len(ran) == min(2, len(ran)) if capacity == 100 else len(ran) >= (1 if capacity == 64 else 6)
        assert rows > 3000 or max(ran) > 1
        fill = collections.defaultdict(list)
        for r in out:
            fill[r["p_sequence"]].append((r["p_offset"], lengths[r["p_key"]]))
        for v in fill.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= capacity
        gaps = []
        for length in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= length]
            gap = min(fits) if fits else capacity
            if fits:
                gaps.remove(gap)
            gaps.append(gap - length)
        assert len(fill) <= len(gaps) * 1.01 + 2


def test_classifier(spark):
    rng = random.Random(9)
    good, bad = ["river", "mountain", "journey", "letter", "window"], ["xqz", "buy", "click", "zzkk", "win$"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(5, 60)))) for i in range(300)]
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(201, None), (None, 1), (202, 7), (3, 0)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "river river"), rows[0]], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    settings = Settings(buckets=1 << 14)
    out = score_documents(docs, train_on(docs, known, settings), settings).collect()
    assert len(out) == 304 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    right = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert sum(right) / len(right) >= 0.95
    none = fit([], np.zeros(0, int), settings)
    assert score_documents(docs.limit(0), none, settings).count() == 0
    assert fit([b"a", b"b"], np.array([1, 1]), settings).bias > 0


def test_classifier_sample_is_bounded(spark, monkeypatch):
    from loomgraph.llm import classifier

    got = []
    monkeypatch.setattr(classifier, "fit", lambda texts, labels, settings: got.append((list(texts), labels.tolist())))
    docs = spark.createDataFrame([(1, "one text")] * 500 + [(i, "x" * 10) for i in range(2, 40)] + [(99, "y" * 5000), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1, 40), 50, 99]], "doc_id long, quality int")
    train_on(docs, labels, Settings(sample=10))
    train_on(docs, labels, Settings(sample_bytes=100))
    train_on(docs.limit(0), labels)
    (ten, _), (small, marks), (none, _) = got
    assert len(ten) == 10 and none == [] and len(small) == len(marks)
    assert sum(len(t or b"") for t in small) <= 100 and sum(len(t or b"") for t in small) > 80


def test_held_out_accuracy(spark):
    import os

    from loomgraph.llm.queries import op10_quality_classifier

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in op10_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) / len(out) >= 0.9


def test_pipeline_stages(spark):
    """Every stage against a plain version of it, on all that the stage before kept."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    from loomgraph.llm.secret_scan import ScanRules, candidates, cutoffs, decoys

    key = "aB3xQ9zR7kLm2Vt8Yw4NpS6dH1jU0cEfG5iK"
    lines = "\n".join(f"l{i} " + " ".join(f"m{i}x{k}" for k in range(8)) for i in range(12))
    rows = brute.corpus(n=160) + [
        (5000, 'say password = "hunter2abc" ' + " ".join(f"n{i}" for i in range(80)), "en", "a", 1, "x", "x", "x"),
        (5001, f"the key {key} is here " + " ".join(f"o{i}" for i in range(80)), "en", "a", 1, "x", "x", "x"),
        (5002, lines + "\n" + "\n".join(lines.split("\n")[:4]), "en", "a", 1, "x", "x", "x"),
    ]
    docs = spark.createDataFrame(rows, brute.DOC_SCHEMA)
    seen = []
    for name, stage in c.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        seen.append(collections.Counter((r["doc_id"], r["text"]) for r in before.collect()))
        if name != "packing":
            assert docs.columns == list(c.COLUMNS)
    assert seen[1] == collections.Counter({k: n for k, n in seen[0].items() if brute.good(k[1])})
    assert 5002 not in {i for i, _ in seen[1]} and brute.rules(rows[-1][1])[5] is False
    ruled = list(seen[1])
    roots = brute.components([brute.simhash(t) for _, t in ruled], lambda a, b: (a ^ b).bit_count() <= 2)
    order = lambda i: (i is None, i if i is not None else 0)
    least = {root: min((ruled[j][0] for j in range(len(ruled)) if roots[j] == root), key=order) for root in set(roots)}
    assert sorted((i for i, _ in seen[2]), key=order) == sorted(least.values(), key=order) and max(seen[2].values()) == 1
    single = [k for k in seen[2]]
    cut = dict(seen[3].keys())
    assert {i: brute.words(t) for i, t in cut.items()} == {i: w for (i, _), w in zip(single, brute.kept_words([t for _, t in single]))}
    assert all(cut[i] == t for (i, t), w in zip(single, brute.kept_words([t for _, t in single])) if w == brute.words(t))
    own, null, found = collections.Counter(), collections.Counter(), {}
    for i, t in cut.items():
        found[i] = candidates(t, brute.base_spans(t))
        own.update((s, b) for _, _, s, b in found[i])
        null.update(decoys(t, found[i]))
    limit = cutoffs([(*k, n) for k, n in own.items()], [(*k, n) for k, n in null.items()], ScanRules())
    for i, t in cut.items():
        spans, masked, at = sorted([(s, e) for s, _, e in brute.base_spans(t)] + [(s, e) for s, e, st, b in found[i] if b <= limit[st]]), "", 0
        for s, e in spans:
            masked, at = masked + (t[at:s] + "[secret]" if s >= at else ""), max(at, e)
        assert dict(seen[4].keys())[i] == masked + t[at:]
    assert "hunter2abc" not in dict(seen[4].keys())[5000] and key not in dict(seen[4].keys())[5001]
    library, want = Tokenizer.from_file(WORD), collections.Counter()
    for i, t in seen[4]:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = docs.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert check_packed(packed, 4096) <= math.ceil(sum(k[3] for k in want) / 4096) + 1
    empty = spark.createDataFrame([], brute.DOC_SCHEMA)
    for _, stage in c.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_counts_and_pieces_on_tables(spark):
    """On the driver's texts the counts and the packed identifiers are the library's."""
    import os

    from tokenizers import Tokenizer

    from loomgraph.llm.token_counts import count_tokens

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library, counts, pieces = Tokenizer.from_file(WORD), {}, collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        counts[r["doc_id"]] = len(ids)
        ids.append(1)
        for k in range(0, len(ids), 4096):
            pieces[r["doc_id"], k // 4096, k, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, WORD).collect()} == counts
    packed = pack_documents(docs, WORD).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in packed) == pieces
    assert check_packed(packed, 4096) <= math.ceil(sum(r["length"] for r in packed) / 4096) + 2
