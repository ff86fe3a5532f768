import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.gru import Lanes, Shape, Trainer, Training, initial, log10_likelihoods, pack, unpack
from loomgraph.llm.lm_scoring import Settings, score_documents

from . import brute

SMALL = Shape(classes=3, class_words=4, tails=5, hidden=6)


def base_rows(texts, train):
    """(n_tokens, n_known, train_tokens, base_score) of each text."""
    split = [[w.decode() for w in brute.words((t or "").encode().lower().decode())] + [None] for t in texts]
    counts = collections.Counter(w for words, own in zip(split, train) if own for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for w in split]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_log10(w, shape, tokens):
    """The log10 probability of one text, a token and a number at a time."""
    n, h, total, last = shape.hidden, np.zeros(shape.hidden), 0.0, shape.start
    sig = lambda x: 1 / (1 + np.exp(-x))
    for token in tokens:
        own, pull = w["inputs"][last].astype(float), h @ w["recur"].astype(float)
        z, r = sig(own[:n] + pull[:n]), sig(own[n : 2 * n] + pull[n : 2 * n])
        h = (1 - z) * h + z * np.tanh(own[2 * n :] + r * pull[2 * n :])
        cls = token // shape.class_words if token < shape.head else shape.classes + token - shape.head
        p = np.exp(h @ w["class_w"] + w["class_b"])
        total += math.log10(p[cls] / p.sum())
        if token < shape.head:
            q = np.exp(h @ w["word_w"][cls] + w["word_b"][cls])
            total += math.log10(q[token % shape.class_words] / q.sum())
        last = token
    return total


def model(seed=1, unused=0):
    rng = np.random.default_rng(seed)
    w = initial(SMALL, np.arange(SMALL.head - unused, 0, -1), np.arange(5) * 3.0)
    return {k: np.where(v < -1e6, v, v + rng.normal(0, 0.5, v.shape)).astype(np.float32) for k, v in w.items()}


def sequences(seed=2, sizes=(0, 1, 7, 200, 3, 50, 64, 65, 1)):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, SMALL.start, n).astype(np.uint16) for n in sizes]


@pytest.mark.parametrize("lanes, steps", [(1, 5), (3, 16), (64, 7)])
def test_likelihood_is_that_of_a_plain_loop(lanes, steps):
    w, texts = model(), sequences()
    assert np.allclose(log10_likelihoods(w, SMALL, texts, lanes, steps), [plain_log10(w, SMALL, t.tolist()) for t in texts], rtol=1e-4)
    assert log10_likelihoods(w, SMALL, []).tolist() == []


def test_probabilities_sum_to_one():
    """Over every next token, tails standing for all their words; identifiers without a word have none."""
    w, shape = model(unused=5), SMALL
    for before in ([], [3], [1, 13, 0, 16]):
        texts = [np.array([*before, k], np.uint16) for k in range(shape.start)]
        own = log10_likelihoods(w, shape, texts) - (log10_likelihoods(w, shape, [np.array(before, np.uint16)])[0] if before else 0)
        assert math.isclose((10**own).sum(), 1, rel_tol=1e-4)
        assert own[shape.head - 5 : shape.head].max() < -1000


def test_gradients_are_slopes():
    """Backpropagation within one window against differences of the loss."""
    w = {k: v.astype(np.float64) for k, v in model().items()}
    lanes = Lanes(sequences(sizes=(4, 9, 3, 8)), 2)
    from loomgraph.llm.gru import _read

    window = next(_read(lanes, SMALL, 32))
    trainer = Trainer(w, SMALL)
    h = np.zeros((2, SMALL.hidden))
    _, grads, loss = trainer.gradients(h, window)
    rng = np.random.default_rng(0)
    for k in w:
        for at in map(tuple, rng.integers(0, w[k].shape, (12, w[k].ndim))):
            was = trainer.w[k][at]
            sides = []
            for step in (1e-2, -1e-2):
                trainer.w[k][at] = was + step
                sides.append(trainer.gradients(h, window)[2])
            trainer.w[k][at] = was
            assert math.isclose((sides[0] - sides[1]) / 2e-2, grads[k][at], rel_tol=2e-2, abs_tol=2e-2), (k, at)


def test_training_learns_order():
    """A fixed order of tokens, which frequencies don't know, is learnt; state crosses windows."""
    text = np.tile(np.arange(12, dtype=np.uint16), 40)
    w = initial(SMALL, np.full(12, 40.0), np.zeros(5))
    trainer = Trainer(w, SMALL, Training(window=8, lanes=4))
    for _ in range(30):
        trainer.read([text] * 8)
    before, after = log10_likelihoods(w, SMALL, [text])[0], log10_likelihoods(trainer.w, SMALL, [text])[0]
    assert before < 480 * -1.0 and after > 480 * -0.3
    again = unpack(pack(trainer.w), w)
    assert all((again[k] == trainer.w[k]).all() for k in w)


def test_base_and_handling(spark):
    texts = [r[1] for r in brute.corpus()] + ["Ünï ÀB Zz zz", "ÀB àb"]
    rows = [(None if i == 7 else i, t, "clash", "clash", i % 3 != 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, block string, own boolean").repartition(3)
    got = {(r.doc_id or -1, r.n_tokens): r for r in score_documents(df, F.col("own"), Settings(shape=SMALL, fan_in=2)).collect()}
    expected = base_rows([t and ascii_lower(t) for t in texts], [r[4] for r in rows])
    assert len(expected) == len(texts)
    for row, (n, known, total, base) in zip(rows, expected):
        r = got[(row[0] or -1, n)]
        assert (r.n_known, r.train_tokens) == (known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_nothing_learnt_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(df, F.lit(None).cast("boolean"), Settings(shape=SMALL)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0.0)
    assert got[2].n_tokens == 1 and got[2].score < 0
    assert score_documents(df.limit(0), F.lit(True)).collect() == []


def test_registered_query_beats_frequencies(spark):
    """On texts held out, by the table's own rows; n and base as a plain count has them."""
    from loomgraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op11_lm_scoring"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    folds = [zlib.crc32(str(d.doc_id).encode()) % 7 for d in docs]
    for d, fold, (n, known, total, base) in zip(docs, folds, base_rows([d.text and ascii_lower(d.text) for d in docs], [f != 2 for f in folds])):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold == 2, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.15 * sum(r.n_tokens for r in held)
