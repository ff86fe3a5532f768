import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm.alignment import Aligner, align_tokenizers, cuts, overlaps, owners
from loomgraph.llm.bpe_words import byte_symbols

from . import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "x ▁ y", "  lead  two \n\n tabs\t x\u0085y　z", "<|endoftext|> <s> a<s>b <0x41> </s>", "日本語 a\x1cb c\x1f d \x1c e​f", "'s it's 'll don 't", "zq" * 3000, "a  b   c    d", "a b   c", "naïve café Straße", "\x00 a\x00b", "line\nline \n line", "🙂🙂 a🙂b 🙂", "0123 45 6", "tail "]


def plain(texts):
    """Rows of the operator (without ids), by whole encodings and all links listed."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own, names = {s: i for i, s in enumerate(byte_symbols())}, {i: t for t, i in a.get_vocab().items()}

    def piece(i):
        byte = re.fullmatch("<0x(..)>", b.id_to_piece(i))
        return bytes.fromhex(byte[1]) if byte else b.id_to_piece(i).replace("▁", " ").encode()

    overlap = []

    def groups(text):
        if not text:
            overlap.append(0)
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left, right = [bytes(own[c] for c in names[i]) for i in x], [piece(i) for i in y]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            overlap.append(0)
            return []
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (left, right)]
        out, was = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            out.append([[i for i, e in zip(ids, end) if was < e <= cut] for ids, end in ((x, ends[0]), (y, ends[1]))])
            was = cut
        begins = [[0, *e[:-1]] for e in ends]
        shared = sum(max(p, r) < min(q, t) for p, q in zip(begins[0], ends[0]) for r, t in zip(begins[1], ends[1])) if len(x) < 500 else None
        overlap.append(shared)
        return out

    every = [groups(t) for t in texts]
    links = [[(i, j) for x, y in g for i in x for j in y] for g in every]
    count = collections.Counter(p for own in links for p in set(own))
    best = collections.Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for g, own, shared in zip(every, links, overlap):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), shared, sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if g else "", bool(g)))
    return out


def check(spark, texts, parts=3):
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    rows = [(i, t, 1, "clash") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair int, block string").repartition(parts)
    hide = lambda r: (*r[:5], None, *r[6:])
    expected = [(i, *p) for i, p in zip(ids, plain(texts))]
    got = [tuple(r) for r in align_tokenizers(df, A, B).collect()]
    assert sorted(map(str, map(hide, got))) == sorted(map(str, map(hide, expected)))
    own = lambda rows: {r for r in rows if r[1] < 400}  # noqa: E731  overlaps of long texts are not counted plainly
    assert {r for r in own(expected) if r[5] is not None} <= own(got)


def test_odd_texts(spark):
    check(spark, ODD + ODD[5:9] * 3 + ["same words here"] * 40)


def test_corpus(spark):
    check(spark, [r[1] for r in brute.corpus()])


def test_registered_query_on_table(spark):
    from loomgraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {(d.doc_id, *p[:4], *p[5:-1]) for d, p in zip(docs, plain([d.text for d in docs]))}
    got = QUERIES["op13_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r) for r in got.collect()} == expected


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.parametrize("a, b, groups, met", [([2, 1], [1, 2], [0, 0, 0], [(0, 0), (0, 1), (1, 1)]), ([1, 2], [1, 1, 1], [0, 1, 1], [(0, 0), (1, 1), (1, 2)]), ([3], [3], [0, 0, 0], [(0, 0)])])
def test_owners(a, b, groups, met):
    left, right = owners(np.array(a)), owners(np.array(b))
    assert cuts(left, right).tolist() == groups
    assert list(zip(*(x.tolist() for x in overlaps(left, right)))) == met


def test_large_group_is_counted():
    """A group of many tokens keeps every link, as counts of its different id pairs."""
    from loomgraph.llm.alignment import counted

    left, right = [5, 6, 5] * 50, [7, 7, 8] * 40
    pairs, n = counted(np.array(left), np.array(right))
    expected = collections.Counter(x << 32 | y for x in left for y in right)
    assert dict(zip(pairs.tolist(), n.tolist())) == expected


def test_groups_over_the_limit(spark, monkeypatch):
    """With a limit of one link every group of more is counted; figures are the same."""
    import loomgraph.llm.alignment as module

    text = ODD[5]
    aligner = Aligner(A, B)
    parts = aligner.segments(text)
    listed = aligner.align(parts)
    monkeypatch.setattr(module, "_LARGE", 1)
    monkeypatch.setattr(module, "_BYTES", 3)
    few = aligner.align(parts)
    assert (listed.figures == few.figures).all() and listed.groups == few.groups
    assert all(_summed(listed, k) == _summed(few, k) for k in range(len(parts)))


def _summed(x, k):
    out = collections.Counter()
    for p, n in zip(x.pairs[x.starts[k] :][: x.sizes[k]].tolist(), x.times[x.starts[k] :][: x.sizes[k]].tolist()):
        out[p] += n
    return out


def test_segments_are_cut_where_both_end():
    whole = Aligner(A, B)
    for text in filter(None, ODD):
        parts = whole.segments(text)
        assert " ".join(parts) == text
        assert [i for p in parts for i in whole.b.encode(p)] == whole.b.encode(text)
