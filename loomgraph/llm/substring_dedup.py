"""Substring dedup over a log-structured fingerprint index.

A window is ``window`` consecutive words; its words go if the same sequence starts anywhere else.
The index does not hold every window: of each window's ``window - GRAM + 1`` runs of GRAM words the
one of least hash, its anchor, stands for it. Equal windows have equal runs, hence the same anchor at
the same offset, so a window that occurs twice always has an anchor that occurs twice: the index has
about one entry for fifteen words and loses nothing. Consecutive windows with one anchor are a block.
What shares an anchor is verified by hashes of the whole word sequence, 96 or 128 bits besides the
anchor's own 64: block by block first, and window by window where no equal block exists.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, map_batches, materialize, own_dir, raw_texts, release
from .wordhash import beyond_second, mix, window_hashes, word_hash_pairs

GRAM = 8
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the run that stands for each window, its position): the least hash, the first of equals."""
    grams = window_hashes(h, GRAM)
    span = window - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return grams[:0], np.zeros(0, np.int64)
    # The least of each span by doubling; positions ride along.
    value, at, width = grams, np.arange(len(grams)), 1

    def least(a, ia, b, ib):
        take = b < a
        return np.where(take, b, a), np.where(take, ib, ia)

    while width * 2 <= span:
        value, at = least(value[:-width], at[:-width], value[width:], at[width:])
        width *= 2
    rest = span - width
    return least(value[:n], at[:n], value[rest : rest + n], at[rest : rest + n])


#: Folders of a batch's texts.
FOLDERS = 64


class FingerprintIndex:
    """Sorted immutable runs of (fp, n) in the folder ``path``: one row for each fingerprint of a batch, bucketed and sorted by it.

    ``add`` writes a batch as a new run and merge-joins it with each older one; its hits are what the
    batch shares with itself or with history. ``maintain`` compacts once there are ``fan_in`` runs.
    Runs share their buckets, so neither shuffles what is indexed already, and an entry is one row
    whatever the number of its occurrences: a hot passage weighs like any other.

    Beside its run a batch leaves its blocks and texts, by which later hits are verified: the blocks in
    the runs' buckets, so a later call's hits find theirs without a shuffle of these, the texts in
    folders by their key, of which a call reads those that hold a hit. An index is of one length of
    windows, and refuses another. ``commit``
    makes all that is new visible at once, by a numbered manifest; what a lost job leaves is never
    read. An index of the same path, in any session, goes on from the newest manifest. Without
    ``path`` it lies in the session's shared folder and lasts as long as the call that made it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan_in: int = 4):
        self.spark, self.fan_in, self.kept = spark, fan_in, path is not None
        self.path = (path or f"{own_dir(spark)}/fpindex-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches: list[str] = []
        self.window: int | None = None
        self.merged = self.compacted = 0  # joins of a batch with an older run, and of two runs into one
        self._stale: list[str] = []
        self._version = 0
        if self.kept:
            self._load()

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _load(self) -> None:
        fs = self._fs()
        if not fs.exists(self._file("manifests")):
            return
        names = [f.getPath().getName() for f in fs.listStatus(self._file("manifests"))]
        newest = max((n for n in names if re.fullmatch(r"[0-9]{9}\.json", n)), default=None)
        if newest:
            m = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{newest}").collect()))
            self.buckets, self.runs, self.batches, self._version = m["buckets"], m["runs"], m["batches"], int(newest[:9])
            self.window = m["window"]
            if m["gram"] != GRAM:
                raise ValueError(f"{self.path} has runs of {m['gram']} words, not {GRAM}")

    def of(self, window: int) -> None:
        """Use the index for windows of so many words, as in all calls before."""
        if self.window not in (None, window):
            raise ValueError(f"{self.path} is an index of {self.window}-word windows, not of {window}")
        self.window = window

    #: Columns of the tables that are bucketed by fp.
    _COLUMNS = {"runs": "fp BIGINT, n BIGINT", "postings": "k BIGINT, j INT, fp BIGINT, d BIGINT, e INT, at BIGINT"}

    def _named(self, name: str) -> str:
        return "fpindex_" + hashlib.md5(f"{self.path}/{name}".encode()).hexdigest()

    def _run(self, name: str, kind: str = "runs") -> DataFrame:
        """A run, or a batch's blocks, as a bucketed table; only the catalog entry belongs to the session."""
        table = self._named(name)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({self._COLUMNS[kind]}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}/{name}'"
        )
        return self.spark.table(table)

    def _write(self, rows: DataFrame, kind: str = "runs") -> str:
        name = uuid.uuid4().hex
        columns = [c.split()[0] for c in self._COLUMNS[kind].split(", ")]
        writer = rows.select(*columns).write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet")
        writer.option("path", f"{self.path}/{kind}/{name}").saveAsTable(self._named(name))
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._named(name)}")

    def add(self, fps: DataFrame) -> DataFrame:
        """Index one batch, a frame of ``fp`` with repeats; returns (fp), written, that occur in it and anywhere else so far."""
        name = self._write(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
        new = self._run(name)
        hits = new.where("n > 1").select("fp")
        for older in self.runs:
            hits = hits.union(new.select("fp").hint("merge").join(self._run(older).select("fp"), "fp"))
            self.merged += 1
        self.runs.append(name)
        return materialize(hits.distinct(), "substring-hits")

    def compact(self) -> None:
        """Merge all runs into one, two at a time, bucket by bucket."""
        while len(self.runs) > 1:
            a, b = (self._run(t).hint("merge") for t in self.runs[:2])
            merged = a.alias("a").join(b.alias("b"), F.col("a.fp") == F.col("b.fp"), "full_outer").select(
                F.coalesce("a.fp", "b.fp").alias("fp"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n")
            )
            self._stale += self.runs[:2]
            self.runs[:2] = [self._write(merged)]
            self.compacted += 1

    def maintain(self) -> None:
        if len(self.runs) >= self.fan_in:
            self.compact()

    def blocks_of(self, hits: DataFrame) -> list[DataFrame]:
        """For each committed batch its blocks of ``hits`` (fp), by merge joins in the runs' buckets."""
        return [self._run(b, "postings").join(hits.hint("merge"), "fp", "left_semi") for b in self.batches]

    def texts_of(self, keys: DataFrame) -> DataFrame | None:
        """Texts of all committed batches in the folders that hold one of ``keys`` (k)."""
        if not self.batches:
            return None
        folders = [r[0] for r in keys.select(F.pmod("k", F.lit(FOLDERS)).alias("p")).distinct().collect()]  # at most so many
        parts = [self.spark.read.parquet(f"{self.path}/texts/{b}").where(F.col("p").isin(folders)).drop("p") for b in self.batches]
        return reduce(DataFrame.unionByName, parts)

    def commit(self, postings: DataFrame, texts: DataFrame) -> None:
        """Keep a batch's blocks and distinct texts for later verification, and publish the new runs."""
        name = self._write(postings.repartition(self.buckets, "fp"), "postings")
        folder = F.pmod("__sd_k", F.lit(FOLDERS)).alias("p")
        texts.select("*", folder).repartition("p", F.pmod("__sd_j", F.lit(SALT))).write.partitionBy("p").parquet(f"{self.path}/texts/{name}")
        self.batches.append(name)
        self.maintain()
        self._version += 1
        fs, new = self._fs(), self._file(f"manifests/new-{name}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "window": self.window, "gram": GRAM, "runs": self.runs, "batches": self.batches}).encode()))
        out.close()
        if not fs.rename(new, self._file(f"manifests/{self._version:09d}.json")):
            raise RuntimeError(f"another job has committed version {self._version} of {self.path}")
        for old in self._stale:
            self._forget(old)
            fs.delete(self._file(f"runs/{old}"), True)
        self._stale = []

    def drop(self) -> None:
        """Delete the index, files and all."""
        for t in [*self.runs, *self.batches, *self._stale]:
            self._forget(t)
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)
        self.runs, self.batches = [], []


def _blocks(h1: np.ndarray, h2: np.ndarray, window: int):
    """(start, windows, anchor hash, digest, second digest) of every block of a text.

    The first and the last window of a block cover all its words, so their hashes make its digest.
    """
    fp, at = anchors(h1, window)
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((cut, [len(at)])))
    last = cut + size - 1
    w1, w2 = window_hashes(h1, window), window_hashes(h2, window)
    wide = size.astype(np.uint64)
    return cut, size, fp[cut], mix(mix(w1[cut], w1[last]), wide), mix(mix(w2[cut], w2[last]), wide)


#: Windows of a block are fewer than this, so start and count share a long.
PACK = 64


def _postings(texts: DataFrame, window: int) -> DataFrame:
    """Every block of each text: text key (k, j), anchor fp, digest (d, e), packed place, and whether it is sure.

    Counts are only compared with 2, so of equal texts in one Arrow batch two speak for all; and of
    equal blocks in one batch two are counted, while the others are sure to be repeated and skip
    every join: a passage that a third of all documents share sends two rows a batch to its key.
    """

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict = {}
            ks, js = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = [[], [], [], [], [], []]
            for i, raw in enumerate(raw_texts(batch.column(2))):
                key = (int(ks[i]), int(js[i]))
                times = seen.get(key, 0)
                words = raw.split() if raw and times < 2 else ()
                if len(words) < window:
                    continue
                seen[key] = times + 1
                start, size, fp, d, e = _blocks(*word_hash_pairs(words), window)
                row = (np.full(len(fp), ks[i]), np.full(len(fp), js[i]), fp.view(np.int64), d.view(np.int64))
                for o, v in zip(out, (*row, e.astype(np.uint32).view(np.int32), start * PACK + size)):
                    o.append(v)
            types = (np.int64, np.int32, np.int64, np.int64, np.int32, np.int64)
            cols = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, types)]
            cols.append(beyond_second(cols[2], cols[3]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "j", "fp", "d", "e", "at", "sure"])

        return kernel

    return map_batches(texts.select("__sd_k", "__sd_j", "__sd_t"), make, "k long, j int, fp long, d long, e int, at long, sure boolean")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(k, j, own, s, w1, w2, sure): each window of the blocks in ``__sd_todo``, hashed in full.

    ``own``: the verdict is wanted; otherwise the block only stands for those equal to it. ``sure``:
    as with blocks, two equal windows of this batch are counted already. A text that occurs again has
    no block whose verdict is wanted, so it does no harm that another batch tells its windows again.
    """
    at = [texts.columns.index(c) for c in ("__sd_k", "__sd_j", "__sd_t", "__sd_todo")]

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: set = set()
            ks, js = batch.column(at[0]).to_numpy(), batch.column(at[1]).to_numpy()
            todo = batch.column(at[3])
            out = [[], [], [], [], [], []]
            for i, raw in enumerate(raw_texts(batch.column(at[2]))):
                if (int(ks[i]), int(js[i])) in seen:
                    continue
                seen.add((int(ks[i]), int(js[i])))
                words = raw.split()
                w1, w2 = (window_hashes(h, window) for h in word_hash_pairs(words))
                packed = todo[i].values.to_numpy()
                own, packed = packed & 1, packed >> 1
                start, size = packed // PACK, packed % PACK
                s = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = (np.full(len(s), ks[i]), np.full(len(s), js[i]), np.repeat(own, size).astype(bool), s)
                for o, v in zip(out, (*row, w1[s].view(np.int64), w2[s].view(np.int64))):
                    o.append(v)
            types = (np.int64, np.int32, bool, np.int64, np.int64, np.int64)
            cols = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, types)]
            cols.append(beyond_second(cols[4], cols[5]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "j", "own", "s", "w1", "w2", "sure"])

        return kernel

    return map_batches(texts, make, "k long, j int, own boolean, s long, w1 long, w2 long, sure boolean")


#: Parts, a power of two, that the rows of one anchor, and of one text, are dealt to where they learn a verdict.
SALT = 4


def _salted(rows: DataFrame) -> DataFrame:
    """A copy of ``rows`` for each part."""
    return rows.withColumn("__sd_s", F.explode(F.expr(f"sequence(0, {SALT - 1})")))


def _of_texts(places: DataFrame, name: str) -> DataFrame:
    """(__sd_ck, __sd_cj, __sd_cs, ``name``): the places (k, j, at) of each text, once for each part."""
    one = places.groupBy(F.col("k").alias("__sd_ck"), F.col("j").alias("__sd_cj")).agg(F.collect_set("at").alias(name))
    return _salted(one).withColumnRenamed("__sd_s", "__sd_cs")


def _with_verdicts(df: DataFrame, text_col: str, window: int, batches: int, index: FingerprintIndex | None) -> DataFrame:
    """``df`` with its text as ``__sd_t`` and ``__sd_cut``: packed (start, count) of windows that occur elsewhere.

    Texts are keyed by a 96-bit hash, not an id: equal texts share one verdict, and repeated or null
    ids do no harm. Batches enter the index one by one, and its hits are what is verified: blocks and
    texts of this call, and of all committed before, that hold a hit. Only the last steps shuffle
    texts, once: both joins read the same exchange. A key, anchor or window of a third of all rows is
    counted map-side first; where its rows must learn a verdict they are dealt to ``SALT`` parts.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    part = F.spark_partition_id().bitwiseAND(F.lit(SALT - 1))  # never null, so both joins below ask for the same exchange
    keyed = df.withColumns({"__sd_t": text, "__sd_k": F.xxhash64(text), "__sd_j": F.hash(text), "__sd_s": part}).drop(text_col)

    postings = materialize(_postings(keyed, window), "substring-postings")
    index = index or FingerprintIndex(spark, fan_in=2)
    index.of(window)
    counted = postings.where("NOT sure").drop("sure")
    hits = []
    for b in range(batches):
        index.maintain()  # the next batch meets few runs
        hits.append(index.add(counted.where(F.pmod("j", F.lit(batches)) == b).select("fp")))
    every = reduce(DataFrame.union, hits).distinct()
    entries = counted.withColumn("__sd_s", F.pmod("k", F.lit(SALT)).cast("int"))
    now = entries.join(_salted(every), ["fp", "__sd_s"]).drop("__sd_s")
    blocks = materialize(reduce(DataFrame.unionByName, [now, *index.blocks_of(every)]), "substring-blocks")
    for h in hits:
        release(h)
    sure = materialize(postings.where("sure").select("k", "j", "at"), "substring-sure")
    groups = blocks.groupBy("fp", "d", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "j", "at")).alias("rep"))
    groups = materialize(groups, "substring-groups")
    whole = blocks.join(groups.where("n > 1").select("fp", "d", "e"), ["fp", "d", "e"]).select("k", "j", "at")
    loose = _salted(groups.where("n = 1").select("fp").distinct())
    dealt = groups.withColumn("__sd_s", F.pmod("d", F.lit(SALT)).cast("int"))
    todo = dealt.join(loose, ["fp", "__sd_s"]).select("rep.k", "rep.j", F.expr("rep.at * 2 + CAST(n = 1 AS INT)").alias("at"))
    old_texts = index.texts_of(todo) if index.kept else None
    todo = _of_texts(todo, "__sd_todo")
    if index.kept:
        once = keyed.where("__sd_t IS NOT NULL").groupBy("__sd_k", "__sd_j").agg(F.max("__sd_t").alias("__sd_t"))
        index.commit(counted, once)
    else:
        index.drop()
    release(postings)

    on = (F.col("__sd_k") == F.col("__sd_ck")) & (F.col("__sd_j") == F.col("__sd_cj")) & (F.col("__sd_s") == F.col("__sd_cs"))
    joined = keyed.join(todo.hint("shuffle_hash"), on).drop("__sd_ck", "__sd_cj", "__sd_cs")
    if old_texts is not None:
        old = old_texts.withColumn("__sd_s", F.lit(0)).join(todo.hint("shuffle_hash"), on)
        need = ("__sd_k", "__sd_j", "__sd_t", "__sd_todo")
        joined = joined.select(*need).union(old.select(*need))
    # In order, so that a task that runs again calls the same windows sure.
    each = _windows(joined.sortWithinPartitions("__sd_k", "__sd_j"), window)
    twice = each.where("NOT sure").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("w1").alias("t1"), F.col("w2").alias("t2"))
    # Spark may run ``each`` anew, on other batches, for each of its uses. What is counted holds for any batches; each
    # verdict is taken from one run, in which a window is sure or meets the count. Sure ones meet nothing, spread by place.
    own = each.where("own").select("k", "j", F.expr(f"s * {PACK} + 1").alias("at"), "sure", F.expr("IF(sure, xxhash64(k, s), w1)").alias("t1"), F.col("w2").alias("t2"))
    single = own.join(twice.withColumn("met", F.lit(True)), ["t1", "t2"], "left").where("sure OR met").select("k", "j", "at")
    cuts = whole.union(sure).union(single)
    return keyed.join(_of_texts(cuts, "__sd_cut").hint("shuffle_hash"), on, "left").drop("__sd_ck", "__sd_cj", "__sd_cs")


def _cutter(window: int):
    """A function from a text and its packed cuts to (words, mask of removed words)."""

    def cut(raw: bytes | None, packed):
        words = (raw or b"").split()
        if packed is None or not len(packed):
            return words, None
        edge = np.zeros(len(words) + 1, np.int32)
        start, size = packed // PACK, packed % PACK
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size - 1 + window, -1)
        return words, np.cumsum(edge[:-1]) > 0

    return cut


def _kept(words: list[bytes], removed) -> bytes:
    if removed is None:
        return b" ".join(words)
    return b" ".join([words[i] for i in np.flatnonzero(~removed).tolist()])


def _kept_text(raw: bytes, removed) -> bytes:
    """The kept words with the white space before each; what a removed run leaves between two words is a line end if it held one, else a space."""
    out, cut, line, end = [], False, False, 0
    for k, m in enumerate(_WORD.finditer(raw)):
        gap, end = raw[end : m.start()], m.end()
        if removed[k]:
            line = (line and cut) or b"\n" in gap
            cut = True
        else:
            out.append((b"\n" if line or b"\n" in gap else b" ") if cut and out else b"" if cut else gap)
            out.append(m[0])
            cut = line = False
    return b"".join(out)


def dedup_substrings(
    df: DataFrame,
    window: int = 35,
    batches: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: FingerprintIndex | None = None,
) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 of the kept words joined by one space, and kept_text.

    A word is removed if a window of ``window`` words covers it whose sequence starts anywhere else
    too, in any document or its own. Windows are judged on the input. Documents enter the index in
    ``batches``. With ``index``, one that has a path, windows that start in documents of earlier calls
    count as well, and these documents are kept in it for later ones; a call adds its documents once,
    and all calls have to use one ``window``.

    Null or empty text: no words. Texts shorter than a window keep all; very long ones are hashed
    whole, in memory of some twenty times their size. Repeated rows remove each other's windows and
    get a row each. Null ids stay null. Empty table: no rows. Other input columns are not read, and
    may have any names.
    """
    judged = _with_verdicts(df.select(id_col, text_col), text_col, window, batches, index)
    judged = judged.select(id_col, "__sd_t", "__sd_cut")
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        cut = _cutter(window)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            cuts, rows = batch.column(2), []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                words, removed = cut(raw, cuts[i].values.to_numpy() if cuts[i].is_valid else None)
                kept = _kept(words, removed)
                rows.append((len(words), 0 if removed is None else int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
            names = [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols[:3], cols[3].cast(pa.string())], names)

        return kernel

    schema = f"{id_col} {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return map_batches(judged, make, schema)


def remove_repeats(
    df: DataFrame, window: int = 35, batches: int = 3, text_col: str = "text", index: FingerprintIndex | None = None
) -> DataFrame:
    """``df`` without the words that ``dedup_substrings`` removes from its texts; kept words keep their line breaks and indentation.

    Texts that lose nothing stay as they are, null ones null; very long ones are cut whole. Repeated
    rows lose the windows they share and stay. Other columns, whatever their names, and rows are
    unchanged. Empty table: no rows.
    """
    judged = _with_verdicts(df, text_col, window, batches, index)
    others = [c for c in df.columns if c != text_col]
    judged = judged.select(*others, "__sd_t", "__sd_cut")
    n = len(others)

    def make():
        cut = _cutter(window)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, cuts = batch.column(n), batch.column(n + 1)
            if cuts.null_count < len(cuts):
                new = []
                for i, raw in enumerate(raw_texts(texts)):
                    new.append(_kept_text(raw, cut(raw, cuts[i].values.to_numpy())[1]) if cuts[i].is_valid else raw)
                texts = pa.array(new, pa.binary()).cast(texts.type)
            return pa.RecordBatch.from_arrays([*batch.columns[:n], texts], [*others, text_col])

        return kernel

    schema = f"{ddl(judged.select(*others))}, `{text_col}` string" if others else f"`{text_col}` string"
    return map_batches(judged, make, schema).select(*df.columns)
