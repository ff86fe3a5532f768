"""Best-fit packing in bulk-synchronous rounds."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_words import WordVocabulary
from .byte_bpe import packed
from .common import BoundedCache, held, map_batches, materialize, raw_texts


def _encoder(vocabulary: str):
    """The vocabulary and its cache of encoded pieces."""
    words = WordVocabulary(vocabulary)
    encode = words.piece_encoder()
    return words, BoundedCache(lambda p: packed(encode(p))).__getitem__


def cut_pieces(
    df: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """One row per piece: piece, start, length, ids_crc32 (and ids): a text's tokens and ``end_id``, cut only if too long."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        words, get = held(("packing", vocabulary), lambda: _encoder(vocabulary))
        end, special = packed([end_id]), {s: packed([i]) for s, i in words.special.items()}

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            src, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                parts = [special[s] if p is None else b"".join(map(get, p)) for s, p in words.parts((raw or b"").decode())]
                data = b"".join([*parts, end])
                for at in range(0, len(data), 4 * capacity):
                    own = data[at : at + 4 * capacity]
                    src.append(i)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").tolist())
            cols = [pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src, pa.int64())), *cols], names)

        return kernel

    schema = f"{id_col} {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(df.select(id_col, text_col), make, schema)


def brackets(capacity: int, least: int = 64) -> list[tuple[int, int]]:
    """Ranges (over, up to) of lengths, the longest first, each half as long as the one before."""
    out, top = [], capacity
    while top > least:
        out.append((top // 2, top))
        top //= 2
    return [*out, (0, top)]


def sweep(lengths: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(gap of each piece, its offset in that gap's room, size that each gap is left with).

    ``lengths`` fall, ``sizes`` rise. A piece goes to its successor, the smallest gap that holds it;
    where several pieces want it, the earlier one has it, and the rest of the gap takes its place
    among the others at once. A piece without a successor opens a sequence, numbered after the gaps.
    """
    left, start = sizes.tolist(), []
    free: dict[int, list[int]] = {}
    for g in range(len(left) - 1, -1, -1):
        free.setdefault(left[g], []).append(g)
    order = sorted(free)
    gap, offset = [], []
    for length in lengths.tolist():
        at = bisect.bisect_left(order, length)
        if at == len(order):
            g, size = len(left), capacity
            left.append(capacity)
            start.append(g)
        else:
            size = order[at]
            g = free[size].pop()
            if not free[size]:
                del free[size], order[at]
        gap.append(g)
        offset.append(size)
        rest = left[g] = size - length
        if rest:
            if rest in free:
                free[rest].append(g)
            else:
                free[rest] = [g]
                bisect.insort(order, rest)
    return gap, offset, left


#: Rows of pieces, or of gaps, that one task of a round sweeps.
SWEEP_ROWS = 16_384
_PLACED = "p_key long, p_sequence long, p_offset long"
_GAPS = "p_sequence long, p_size long"


def _dealt(rows: DataFrame, order: list, tasks: int) -> DataFrame:
    """``rows`` sorted by ranges, and dealt in that order to ``tasks`` tasks, so that each has the same mixture of sizes."""
    if tasks == 1:
        return rows.withColumn("p_task", F.lit(0))
    ranges = min(tasks, 4096)
    ranked = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # Partition in the upper bits, rank within the range in the lower 33; what is dealt is written at once.
    place = F.monotonically_increasing_id()
    rank = place.bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright(place, 33)
    return ranked.withColumn("p_task", F.pmod(rank, F.lit(tasks)).cast("int"))


def _round(pieces: DataFrame, gaps: DataFrame, tasks: int, number: int, capacity: int) -> DataFrame:
    """One superstep: (p_key, p_sequence, p_offset, null) of every piece, and (null, p_sequence, null, p_size) of every gap left."""
    names = ["p_key", "p_sequence", "p_offset", "p_size"]

    def match(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        task = int(key[0].as_py())
        left = left.sort_by([("p_length", "descending"), ("p_key", "ascending")])
        right = right.sort_by([("p_size", "ascending"), ("p_sequence", "ascending")])
        lengths, sizes = left["p_length"].to_numpy(), right["p_size"].to_numpy()
        gap, before, rest = sweep(lengths, sizes, capacity)
        ids = right["p_sequence"].to_pylist()
        # A new sequence is named by its round, task and place there.
        ids += [((number << 31 | task) << 24) + k for k in range(len(rest) - len(ids))]
        open_ = [(i, r) for i, r in zip(ids, rest) if r]
        n, m = len(gap), len(open_)
        return pa.table(
            [
                pa.array(left["p_key"].to_pylist() + [None] * m, pa.int64()),
                pa.array([ids[g] for g in gap] + [i for i, _ in open_], pa.int64()),
                pa.array([capacity - b for b in before] + [None] * m, pa.int64()),
                pa.array([None] * n + [r for _, r in open_], pa.int64()),
            ],
            names=names,
        )

    left = _dealt(pieces, [F.desc("p_length"), F.asc("p_key")], tasks)
    right = _dealt(gaps, [F.asc("p_size"), F.asc("p_sequence")], tasks)
    both = left.groupBy("p_task").cogroup(right.groupBy("p_task"))
    return both.applyInArrow(match, "p_key long, p_sequence long, p_offset long, p_size long")


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """(p_key, p_sequence, p_offset) of ``pieces`` (p_key, p_length), by best-fit in bulk-synchronous rounds.

    A round takes the pieces of one bracket of lengths, the longest first. Pieces and the gaps that
    may hold one of them are range-sorted by size and dealt in that order, each to one task, so no
    two tasks want the same gap; a task sweeps its pieces from long to short, each to its successor
    among the gaps. The gaps of all tasks are written, and the next round sorts them anew. The number
    of rounds depends on ``capacity`` alone, and that of a round's tasks on its rows.
    """
    spark = pieces.sparkSession
    ranges = brackets(capacity)
    which = F.lit(len(ranges) - 1)
    for k in reversed(range(len(ranges))):
        which = F.when(F.col("p_length") > ranges[k][0], k).otherwise(which)
    # As the brackets are ordered, the first that a length exceeds the floor of is its own.
    counts = {r["k"]: r["n"] for r in pieces.groupBy(which.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    gaps = spark.createDataFrame([], _GAPS)
    placed = spark.createDataFrame([], _PLACED)
    for k, (low, top) in enumerate(ranges):
        if not counts.get(k):
            continue
        fit = gaps.where(F.col("p_size") > low)
        tasks = -(-max(counts[k], fit.count()) // SWEEP_ROWS)
        mine = pieces.where((F.col("p_length") > low) & (F.col("p_length") <= top))
        done = materialize(_round(mine, fit, tasks, k + 1, capacity), f"packing-round-{k}")
        placed = placed.union(done.where("p_key IS NOT NULL").select("p_key", "p_sequence", "p_offset"))
        now = gaps.where(F.col("p_size") <= low).union(done.where("p_key IS NULL").select("p_sequence", "p_size"))
        gaps = materialize(now, f"packing-gaps-{k}")
    return placed


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Texts are encoded once and the pieces written; the rounds of ``best_fit`` move only keys and
    lengths, which meet their pieces again in one join by a unique key.

    Null or empty text: one piece of ``end_id`` alone. Very long texts are encoded whole and cut into
    pieces of ``capacity``. Pieces of equal length are placed in the order of their keys. Repeated
    rows: pieces of their own. Null ids stay null. Empty table: no rows. Other input columns are not
    read.
    """
    cut = cut_pieces(df, vocabulary, capacity, end_id, id_col, text_col, with_ids)
    names = cut.columns
    pieces = materialize(cut.withColumn("p_key", F.monotonically_increasing_id()), "packing-pieces")
    placed = best_fit(pieces.select("p_key", F.col("length").alias("p_length")), capacity)
    found = pieces.join(placed, "p_key")
    return found.select(*names, F.col("p_sequence").alias("sequence_id"), F.col("p_offset").alias("offset"))
