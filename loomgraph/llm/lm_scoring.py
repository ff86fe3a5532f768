"""Language-model scores of whole documents by a gated recurrent model that is trained on the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Numbered, from_planes, map_blocks, planes, rows, sums
from .common import bounded_batches, map_batches, materialize, raw_texts, release
from .gru import Shape, Trainer, Training, Weights, initial, log10_likelihoods, pack, unpack

#: What stands for a text's end; no word is empty.
END = b""


@dataclass(frozen=True)
class Settings:
    """``pilot_docs``, ``pilot_tokens``: the most that the first pass, on the driver, reads; the second one reads every training text."""

    shape: Shape = field(default_factory=Shape)
    training: Training = field(default_factory=Training)
    pilot_docs: int = 2000
    pilot_tokens: int = 500_000
    #: Models averaged by one task.
    fan_in: int = 8
    seed: int = 42


def tail_of(word: Column, tails: int) -> Column:
    """The tail class of a word without an identifier: by its last three characters, which tell languages and kinds of word."""
    return (F.crc32(F.substring(word, -3, 3).cast("binary")) % tails).cast("int")


def _blocks(df: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Texts as numbers of their block's words, and each block's words with the times that its training texts hold them."""
    id_field = df.select(id_col).schema[0]
    out = df.select(id_col, text_col, train.alias("lm_train"))

    def make():
        def kernel(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("block", pa.int64()), ("id", batch.column(0).type), ("train", pa.bool_()), ("at", pa.int32()), ("tokens", pa.binary()), ("word", pa.string()), ("times", pa.int64())])
            number, texts = Numbered(), []
            for raw in raw_texts(batch.column(1)):
                words = (raw or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
                words.append(END)
                texts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
            train = batch.column(2).to_numpy(zero_copy_only=False)
            yield rows(schema, len(texts), block=[block] * len(texts), id=batch.column(0), train=batch.column(2), at=np.arange(len(texts), dtype=np.int32), tokens=list(map(planes, texts)))
            n = len(number)
            learnt = [t for t, own in zip(texts, train) if own]
            times = np.bincount(np.concatenate(learnt), minlength=n) if learnt else np.zeros(n, np.int64)
            words = pa.array(number.keys_in_order, pa.binary()).cast(pa.string())
            yield rows(schema, n, block=np.full(n, block), at=np.arange(n, dtype=np.int32), word=words, times=times)

        return kernel

    schema = f"block long, id {id_field.dataType.simpleString()}, train boolean, at int, tokens binary, word string, times long"
    return materialize(map_blocks(out, make, schema), "lm-blocks", "zstd")


@dataclass
class Counts:
    """Counts of the training tokens: a row for each word; of all of them, of the head and of the tails, numbers of fixed size."""

    words: DataFrame
    tokens: int
    distinct: int
    head: list[tuple[str, int]]
    tails: dict[int, tuple[int, int]]


def count_words(blocks: DataFrame, shape: Shape) -> Counts:
    """The most frequent words (ties: of least code points) get identifiers; the others are counted by tail class."""
    own = blocks.where("times > 0").groupBy("word").agg(F.sum("times").alias("n"))
    own = materialize(own.select("word", "n", tail_of(F.col("word"), shape.tails).alias("tail")), "lm-counts")
    head = [(r["word"], r["n"]) for r in own.orderBy(F.desc("n"), "word").limit(shape.head).collect()]
    total = own.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    tails = {r["tail"]: [r["n"], r["v"]] for r in total.collect()}
    tokens, distinct = sum(n for n, _ in tails.values()), sum(v for _, v in tails.values())
    if head:
        names = own.sparkSession.createDataFrame([(w, i) for i, (w, _) in enumerate(head)], "word string, head int")
        own = own.join(F.broadcast(names), "word", "left")
        for r in own.where("head IS NOT NULL").select("tail", "n").collect():  # as many as the head's words
            tails[r["tail"]][0] -= r["n"]
            tails[r["tail"]][1] -= 1
    else:
        own = own.withColumn("head", F.lit(None).cast("int"))
    return Counts(own, tokens, distinct, head, {k: tuple(v) for k, v in tails.items()})


def _encoded(blocks: DataFrame, counts: Counts, shape: Shape, id_col: str) -> DataFrame:
    """A row per document: base_score, n_tokens, n_known, rest (log10 probability of its tail words within their classes), and its model identifiers."""
    id_field = blocks.select("id").schema[0]
    asked = blocks.where("word IS NOT NULL").select(F.col("block").alias("of_block"), F.col("at").alias("place"), "word")
    known = counts.words.select("word", "n", "head")
    # One number tells it all: a head word's identifier, below zero, or a tail word's count and class.
    rare = F.coalesce("n", F.lit(0)) * shape.tails + tail_of(F.col("word"), shape.tails)
    told = asked.join(known, "word", "left").select("of_block", "place", F.coalesce(-1 - F.col("head"), rare).alias("told"))
    head_n = np.array([n for _, n in counts.head] or [0], np.int64)
    log_base = np.log10(counts.tokens + counts.distinct + 1.0)
    tails = np.zeros(shape.tails)
    for k, (n, v) in counts.tails.items():
        tails[k] = n + v
    log_tails = np.log10(tails + 1)
    head, tails_n, wide = shape.head, shape.tails, np.uint16 if shape.start <= 1 << 16 else np.uint32
    names = [id_col, "block", "at", "train", "n_tokens", "n_known", "base_score", "rest", "ids"]

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        told = np.zeros(len(right), np.int64)
        told[right["place"].to_numpy()] = right["told"].to_numpy()
        known = np.maximum(-1 - told, 0)
        n = np.where(told < 0, head_n[known], told // tails_n)
        own = np.where(told < 0, known, head + told % tails_n)
        log_n = np.log10(n + 1)
        rest = np.where(own >= head, log_n - log_tails[np.maximum(own - head, 0)], 0)
        texts = list(map(from_planes, left["tokens"].to_pylist()))
        flat, sizes = np.concatenate(texts), np.array(list(map(len, texts)), np.int64)
        figures = [sizes, sums((n > 0).astype(np.int64)[flat], sizes), sums((log_n - log_base)[flat], sizes), sums(rest[flat], sizes)]
        ids = own.astype(wide)
        return pa.table([left["id"], left["block"], left["at"], left["train"], *map(pa.array, figures), pa.array([ids[t].tobytes() for t in texts], pa.binary())], names=names)

    schema = f"`{id_col}` {id_field.dataType.simpleString()}, block long, at int, train boolean, n_tokens long, n_known long, base_score double, rest double, ids binary"
    texts = blocks.where("tokens IS NOT NULL").select("block", "id", "at", "train", "tokens")
    return materialize(texts.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(finish, schema), "lm-texts", "zstd")


def _ids(column: pa.Array, shape: Shape) -> list[np.ndarray]:
    wide = np.uint16 if shape.start <= 1 << 16 else np.uint32
    return [np.frombuffer(b, wide) for b in column.to_pylist()]


def _pilot(texts: DataFrame, weights: Weights, s: Settings) -> Weights:
    """``weights`` after a first pass, on the driver, over training texts of least hash: bounded in number and in tokens."""
    order = F.xxhash64("block", "at")
    chosen, room = [], s.pilot_tokens
    for r in texts.where("train").select("block", "at", "n_tokens").orderBy(order, "block", "at").limit(s.pilot_docs).collect():
        if r["n_tokens"] <= room:
            room -= r["n_tokens"]
            chosen.append((r["block"], r["at"]))
    if not chosen:
        return weights
    picked = F.broadcast(texts.sparkSession.createDataFrame(chosen, "block long, at int"))
    got = texts.join(picked, ["block", "at"]).select("block", "at", "ids").toArrow().sort_by([("block", "ascending"), ("at", "ascending")])
    trainer = Trainer(weights, s.shape, s.training)
    trainer.read(_ids(got["ids"], s.shape))
    return trainer.w


def _trained(texts: DataFrame, weights: Weights, s: Settings) -> Weights:
    """The average, by tokens read, of the models that each task makes of ``weights`` with all its training texts.

    A model is a row of fixed size; they are averaged in a tree of ``fan_in``, so that no task and
    not the driver ever holds those of all tasks.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(pack(weights))
    like = {k: np.empty(v.shape, np.float32) for k, v in weights.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in batches:
            if batch.num_rows:
                trainer = trainer or Trainer(unpack(sent.value, like), s.shape, s.training)
                trainer.read(_ids(batch.column(0), s.shape))
        if trainer:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([pack(trainer.w)], pa.binary())], ["task", "tokens", "model"])

    def mean(key: tuple, group: pa.Table) -> pa.Table:
        tokens, total = group["tokens"].to_numpy(), 0.0
        for n, raw in zip(tokens.tolist(), group["model"]):
            total = total + np.frombuffer(raw.as_py(), "<f4").astype(np.float64) * n
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([int(tokens.sum())], pa.int64()), pa.array([(total / tokens.sum()).astype("<f4").tobytes()], pa.binary())], names=["task", "tokens", "model"])

    bounded_batches(spark)
    schema = "task long, tokens long, model binary"
    models = materialize(texts.where("train").select("ids").mapInArrow(run, schema), "lm-models")
    while models.count() > 1:
        fewer = models.withColumn("group", F.expr(f"task div {s.fan_in}")).groupBy("group").applyInArrow(lambda key, table: mean(key, table), schema)
        after = materialize(fewer, "lm-models")
        release(models)
        models = after
    found = models.select("model").first()
    return unpack(found["model"], like) if found else weights


def score_documents(
    df: DataFrame, train: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score, score, learnt on rows for which ``train`` is true.

    Tokens are the words, A-Z in lower case, and one end. base_score: log10 of add-one frequencies.
    score: log10 of the model's probability, which sums to one over all known words and, in each tail
    class, one unknown word. The most frequent words are told by a class and a word within it, both by
    the state of a gated recurrent network; any other word by its tail class, told by the state too,
    and by its add-one frequency within it.

    Counts are of all training texts: a block (a batch of texts, bounded in bytes) sends each of its
    words once, and gets back its count. The network begins at the corpus's frequencies; after a
    bounded pilot pass every task reads all its training texts from there, whole, by truncated
    backpropagation, and the models are averaged. So the model depends a little on how rows lie in
    tasks. Scores come from whole texts too: the state is carried from window to window.

    Null or empty text: the end alone. Very long texts: read whole. ``train`` null: not learnt from.
    Repeated rows: a row each, learnt from each. Null ids stay null. Without training texts all words
    are unknown: base_score 0, score that of equal tail classes. Empty table: no rows. Other input
    columns are not read.
    """
    s = settings
    blocks = _blocks(df, F.coalesce(train, F.lit(False)), id_col, text_col)
    counts = count_words(blocks, s.shape)
    texts = _encoded(blocks, counts, s.shape, id_col)
    release(blocks)
    tails = np.zeros(s.shape.tails)
    for k, (n, _) in counts.tails.items():
        tails[k] = n
    weights = initial(s.shape, np.array([n for _, n in counts.head]), tails, s.seed)
    weights = _trained(texts, _pilot(texts, weights, s), s)
    sent, like = texts.sparkSession.sparkContext.broadcast(pack(weights)), {k: np.empty(v.shape, np.float32) for k, v in weights.items()}
    id_type = texts.schema[id_col].dataType.simpleString()

    def make():
        w = unpack(sent.value, like)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = log10_likelihoods(w, s.shape, _ids(batch.column(5), s.shape), s.training.lanes)
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found + batch.column(4).to_numpy())], [id_col, "n_tokens", "n_known", "base_score", "score"])

        return kernel

    scored = map_batches(texts.select(id_col, "n_tokens", "n_known", "base_score", "rest", "ids"), make, f"`{id_col}` {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(id_col, "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
