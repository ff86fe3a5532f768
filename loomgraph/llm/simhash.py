"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, ddl, map_batches, materialize, raw_texts

#: A signature with more members than this is verified by a second index instead of by pairs.
PAIRS_UP_TO = 32
_SHINGLES = 4096


def fingerprint(raw: bytes | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SHINGLES):
        bits = np.unpackbits(hashes[k : k + _SHINGLES].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str, size: int = 3, seed: int = 42) -> DataFrame:
    """``df`` without its text, and with ``__sh_fp``: the fingerprint as a signed long."""
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(text_col, *keep)

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, size, seed) for t in raw_texts(batch.column(0))], np.uint64)
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], [*keep, "__sh_fp"])

        return kernel

    return map_batches(rows, make, f"{ddl(rows.select(*keep))}, `__sh_fp` long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints ``fp`` as links at two differing bits or fewer do.

    A fingerprint is cut into two segments of 32 bits; two that differ in two bits at most agree in
    one segment but for one bit. Each segment is indexed whole (w = 32) and with each of its bits
    deleted (w = 0..31). A pair that agrees in the segment meets under the whole one; one that
    differs in bit w meets under variant w, on its two sides, so no pair meets twice in a segment.
    The equality join gives candidates, the bit count of the difference verifies them.

    A signature of over ``PAIRS_UP_TO`` fingerprints is not paired. Its members link just when the
    other segment differs in the bits left over (two, or one under a deleted bit), so they are
    indexed once more: by all values within one bit of the other segment, or by its own one-bit
    deletions. All that meet there link, at most 33 to a value, and an edge to the least is enough.

    The planner takes exploded rows for as few as they come from, and would broadcast all signatures
    by way of the driver; so the joins of signatures are told to shuffle both sides.
    """
    # A fingerprint becomes 66 signatures: spread them before they are made, not as their files happen to lie.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    seg = spread.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("s"), F.expr("shiftrightunsigned(fp, 32)").alias("own"), F.expr("fp & 4294967295L").alias("other")),
                F.struct(F.lit(1).alias("s"), F.expr("fp & 4294967295L").alias("own"), F.expr("shiftrightunsigned(fp, 32)").alias("other")),
            )
        ).alias("x"),
    ).select("fp", "x.*")
    sigs = seg.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(32)))).select(
        "fp",
        "other",
        F.expr("CASE WHEN w < 32 THEN CAST(shiftright(own, w) & 1L AS INT) ELSE 0 END").alias("side"),
        F.expr("w < 32").alias("deleted"),
        F.expr("(s * 33L + w) * 4294967296L + (CASE WHEN w < 32 THEN own & ~shiftleft(1L, w) ELSE own END)").alias("sig"),
    )
    met = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.first("deleted").alias("del"))
    met = met.where("n > 1 AND (NOT del OR lo <> hi)").select("sig", "n")
    rows = materialize(sigs.join(met.hint("merge"), "sig"), "simhash-met")

    few = rows.where(F.col("n") <= PAIRS_UP_TO)
    left = few.select("sig", "deleted", F.col("fp").alias("u"), F.col("side").alias("su"))
    right = few.select("sig", F.col("fp").alias("v"), F.col("side").alias("sv"))
    pairs = left.join(right.hint("merge"), "sig").where(
        "((deleted AND su < sv) OR (NOT deleted AND u < v)) AND bit_count(u ^ v) <= 2"
    ).select("u", "v")

    many = rows.where(F.col("n") > PAIRS_UP_TO)
    near = F.expr("transform(sequence(0, 32), j -> CASE WHEN j < 32 THEN other ^ shiftleft(1L, j) ELSE other END)")
    gone = F.expr("transform(sequence(0, 31), j -> j * 4294967296L + (other & ~shiftleft(1L, j)))")
    again = many.select("fp", "sig", F.explode(F.when(F.col("deleted"), gone).otherwise(near)).alias("z"))
    least = again.groupBy("sig", "z").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = again.join(least.select("sig", "z", "v").hint("merge"), ["sig", "z"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars)


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42
) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component_id, the smallest id linked to it, directly or not.

    Equal fingerprints are one vertex, so copies are never paired. Texts are read once; fingerprints
    and ids alone are shuffled. A table of them is small in bytes even with millions of rows, so the
    joins of documents and fingerprints are told to shuffle too, not to broadcast by way of the driver.

    Null or empty text, or one of spaces: fingerprint zero, linked like any other. Very long texts:
    every shingle votes. Fewer words than
    ``size``: one shingle of all. Null ids stay null; a component is named by one only if it has no
    other. Repeated rows: a row each. Empty table: no rows. Other input columns are not read.
    """
    fps = materialize(fingerprints(df.select(id_col, text_col), text_col, size, seed), "simhash-fps")
    firsts = _first_of_groups(fps, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")))
    return _with_firsts(fps, firsts).select(
        id_col, F.lower(F.lpad(F.hex("__sh_fp"), 16, "0")).alias("fingerprint"), F.col("__sh_first.id").alias("component_id")
    )


#: A key of more than one in so many rows is hot; there are never more hot keys than that.
HOT = 1000


def _hot(counts: DataFrame, key: list[str]) -> DataFrame:
    """The keys of ``counts`` (key, n) with more than one in ``HOT`` rows: at most ``HOT``, so they may be broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return F.broadcast(counts.where(F.col("n") * HOT > total).select(*key).limit(HOT))


def _with_firsts(fps: DataFrame, firsts: DataFrame) -> DataFrame:
    """``fps`` with the verdict on their fingerprint: rows of hot ones stay where they lie, the others are shuffled to it."""
    hot = _hot(firsts, ["__sh_fp", "__sh_first"])
    rest = fps.join(hot.select("__sh_fp"), "__sh_fp", "left_anti").join(firsts.drop("n").hint("merge"), "__sh_fp")
    return fps.join(hot, "__sh_fp").select(*fps.columns, "__sh_first").union(rest.select(*fps.columns, "__sh_first"))


def _first_of_groups(fps: DataFrame, order: Column) -> DataFrame:
    """(__sh_fp, __sh_first, n), written: the least ``order`` in the component of each fingerprint, and its rows."""
    distinct = materialize(fps.groupBy("__sh_fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = links(distinct.select(F.col("__sh_fp").alias("fp")))
    comps = connected_components(edges, "simhash")
    named = distinct.join(comps.hint("merge"), distinct["__sh_fp"] == comps["node"], "left").select(
        "__sh_fp", "first", "n", F.coalesce("component", "__sh_fp").alias("c")
    )
    firsts = named.groupBy("c").agg(F.min("first").alias("__sh_first"))
    return materialize(named.select("__sh_fp", "n", "c").join(firsts.hint("merge"), "c").select("__sh_fp", "__sh_first", "n"), "simhash-firsts")


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42
) -> DataFrame:
    """The row of smallest id of each group of ``simhash_groups``, columns unchanged.

    Of rows equal in id, one stays; null ids come last. Null texts and texts without words are near
    copies of each other. Very long texts count whole. Empty table: no rows. Columns of any other names
    are kept as they are.

    Only the winners' keys are joined with the rows, which are shuffled once, by a hash of id and text.
    Rows that are repeated, in id and text, are taken once by an aggregate, combined where they lie; a
    key of many of them never meets in one task.
    """
    keys = {"__sh_k": F.xxhash64(id_col, text_col), "__sh_j": F.hash(id_col, text_col)}
    on = list(keys)
    own = df.withColumns(keys)
    slim = own.select(F.col(id_col).alias("__sh_id"), *on, text_col)
    fps = materialize(fingerprints(slim, text_col, size, seed), "simhash-fps")
    order = F.struct(F.col("__sh_id").isNull().alias("none"), F.col("__sh_id").alias("id"), *on)
    kept = materialize(_first_of_groups(fps, order).select("__sh_first.__sh_k", "__sh_first.__sh_j").distinct(), "simhash-kept")
    counts = materialize(fps.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "simhash-counts")
    again = counts.where("n > 1").select(*on)
    if again.isEmpty():
        return own.join(kept, on, "left_semi").select(*df.columns)
    once = own.join(kept.join(again.hint("merge"), on, "left_anti"), on, "left_semi").select(*df.columns)
    # Of repeated rows first those of hot keys, which are few enough to be sent to the rows, then the rest.
    hot = _hot(counts.where("n > 1"), on)
    many = own.join(F.broadcast(hot.join(kept, on, "left_semi").limit(HOT)), on, "left_semi")
    some = own.join(kept.join(again.hint("merge"), on, "left_semi").join(hot, on, "left_anti"), on, "left_semi")
    for part in (many, some):
        first = part.groupBy(*on).agg(F.first(F.struct(*df.columns)).alias("__sh_row"))
        once = once.union(first.select("__sh_row.*"))
    return once
