"""A quality classifier of supervised subword embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_texts
from .wordhash import mix, window_hashes, word_hashes


@dataclass(frozen=True)
class Settings:
    """``sample``: the most labelled documents the model is fitted on, those of least hash of their id; ``sample_bytes``: the most text they hold."""

    sample: int = 8000
    sample_bytes: int = 64 << 20
    buckets: int = 1 << 18
    dim: int = 8
    grams: tuple[int, int] = (3, 5)
    epochs: int = 4
    #: A small sample is gone through more often, up to so many steps.
    least_steps: int = 8000
    rate: float = 20.0
    seed: int = 42


def features(raw: bytes | None, settings: Settings) -> np.ndarray:
    """Every hashed feature of a text, repeats included: its words, their character n-grams, its word pairs.

    A word stands between < and >; n-grams are hashed at all places of the whole text at once, and
    those that cross a word's end are left out.
    """
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    own = word_hashes(words)
    parts = [own, mix(own[:-1], own[1:])]
    text = (b"<" + b"><".join(words) + b">").decode()
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = map(len, words) if text.isascii() else (len(w.decode()) for w in words)
    sizes = np.fromiter(lengths, np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters up to the word's end
    for n in range(settings.grams[0], settings.grams[1] + 1):
        grams = window_hashes(chars, n)
        parts.append(grams[left[: len(grams)] >= n])
    return (np.concatenate(parts) % np.uint64(settings.buckets)).astype(np.int64)


@dataclass
class Model:
    """For each feature its share of the difference of the two logits: what softmax over averaged vectors needs."""

    weights: np.ndarray
    bias: float


def fit(texts: list[bytes | None], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent, a document a step, the rate falling linearly to zero.

    A document is the average of its features' vectors; softmax over a linear layer gives the two
    classes. Without texts, or of one class only, the model scores the share of class 1 (0.5 if none).
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(s.buckets, np.float32), prior)
    docs = []
    for text in texts:
        at, n = np.unique(features(text, s), return_counts=True)
        docs.append((at.astype(np.int32), n.astype(np.float32)))
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    layer, bias = np.zeros((2, s.dim)), np.array([0.0, prior])
    layer += rng.normal(0, 0.1, layer.shape)
    epochs = max(s.epochs, -(-s.least_steps // len(docs)))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, n = docs[i]
            rate = 1 - step / steps
            step += 1
            if not len(at):
                continue
            part = (n / n.sum())[:, None]
            rows = table[at]
            hidden = (rows * part).sum(0)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer.T @ p
            layer -= 0.05 * rate * np.outer(p, hidden)
            bias -= 0.01 * rate * p
            table[at] = rows - s.rate * rate * part * back
    return Model((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def train_on(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """Fit on at most ``settings.sample`` labelled documents of ``settings.sample_bytes`` in all; only those reach the driver.

    The documents come in the order of their id's hash; one that no longer fits the bytes is left
    out, and so is a very long text that alone exceeds them. Labels other than 0 and 1, and rows of
    null ids or labels, teach nothing. Repeated labels of an id count by their largest, repeated
    documents of an id once, by the largest text in byte order. Null text: no features. Empty tables:
    the model of no documents.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("__qc_id")).agg(F.max(label_col).alias("__qc_label"))
    rows = docs.select(F.col(id_col).alias("__qc_id"), F.col(text_col).alias("__qc_text"))
    # Sizes first, of documents that exist; the sample's bound is a setting, so is that of what is collected here.
    sizes = rows.groupBy("__qc_id").agg(F.max(F.octet_length("__qc_text")).alias("bytes")).join(known, "__qc_id")
    chosen, room = [], settings.sample_bytes
    for r in sizes.orderBy(F.xxhash64("__qc_id"), "__qc_id").limit(settings.sample).collect():
        if (r["bytes"] or 0) <= room:
            room -= r["bytes"] or 0
            chosen.append((r["__qc_id"], r["__qc_label"]))
    if not chosen:
        return fit([], np.zeros(0, int), settings)
    schema = f"__qc_id {dict(rows.dtypes)['__qc_id']}, __qc_label int"
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, schema))
    got = rows.join(picked, "__qc_id").groupBy("__qc_id").agg(F.max("__qc_text").alias("__qc_text"), F.max("__qc_label").alias("__qc_label"))
    got = got.toArrow().sort_by("__qc_id")
    texts = [t for c in got["__qc_text"].chunks for t in raw_texts(c)]
    return fit(texts, got["__qc_label"].to_numpy(), settings)


def score_documents(
    docs: DataFrame, model: Model, settings: Settings = Settings(), threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: score (probability of class 1) and predicted (1 if score >= threshold).

    The average of vectors is linear, so a text's score is the mean of its features' weights: one
    broadcast array of ``buckets`` floats, of fixed size. Whole texts are read, where they lie.

    Null or empty text: the model's bias alone. Very long texts: all their features count. Repeated
    rows: a row each. Null ids stay null. Empty table: no rows. Other input columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        weights = model.weights.astype(np.float64)

        def score(raw: bytes | None) -> float:
            at = features(raw, settings)
            logit = model.bias + (float(weights[at].mean()) if len(at) else 0.0)
            return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [score(t) for t in raw_texts(batch.column(1))]
            predicted = pa.array([int(x >= threshold) for x in scores], pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), predicted], [id_col, "score", "predicted"])

        return kernel

    return map_batches(docs.select(id_col, text_col), make, f"{id_col} {id_type}, score double, predicted int")
