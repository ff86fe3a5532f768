"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distributed_rank

#: Ordered buckets of a stratum, and of the whole order: three and four hex digits' worth.
HASH_DIGITS = 3
FRACTION_BUCKETS = 4096


def interleave_shards(
    df: DataFrame,
    num_shards: int,
    *,
    stratum: str = "source",
    id_col: str = "doc_id",
    seed: int = 42,
    tie_breaks: list[Column] | None = None,
) -> DataFrame:
    """Add ``shard`` (0..num_shards-1) and ``slot`` (gapless from 0 in each shard) to every row.

    Rows of each stratum are shuffled by a seeded MD5 of the id and ranked; a row's fractional rank
    is (rank + 0.5) / rows of its stratum; all rows are sorted by it, and the order is cut into
    ``num_shards`` runs whose lengths differ by one at most. A run spans an equal share of every
    stratum's fractions, so each shard matches the mixture.

    Null stratum: a stratum of its own. Texts are not looked at: very long ones weigh as any row, and
    equal texts of different ids are shuffled apart like other rows (law ``rows`` counts, it does not group). Null or repeated ids: shuffled alike, then ordered by
    ``tie_breaks``; rows equal in all of these are interchangeable. Empty table: no rows. Fewer
    rows than shards: some shards stay empty. Input columns named ``shard`` or ``slot`` are replaced.
    """
    ties = tie_breaks or []
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = df.drop("shard", "slot").withColumns({"__il_h": key, "__il_s": F.col(stratum).cast("string")})
    ranked = distributed_rank(
        rows, ["__il_s"], F.substring("__il_h", 1, HASH_DIGITS), [F.col("__il_h"), *ties], "__il_r"
    )
    placed = ranked.withColumn("__il_f", (F.col("__il_r") + 0.5) / F.col("__il_r_n").cast("double")).drop("__il_r", "__il_r_n")
    whole = distributed_rank(
        placed,
        [],
        F.floor(F.col("__il_f") * FRACTION_BUCKETS),
        [F.col("__il_f"), F.col("__il_s").asc_nulls_first(), F.col("__il_h"), *ties],
        "__il_p",
    )
    shard = F.expr(f"(({num_shards}L * (__il_p + 1)) - 1) div __il_p_n")
    return (
        whole.withColumn("__il_shard", shard)
        .withColumn("slot", F.expr(f"__il_p - (__il_shard * __il_p_n) div {num_shards}L"))
        .withColumn("shard", F.col("__il_shard").cast("int"))
        .drop("__il_h", "__il_s", "__il_f", "__il_p", "__il_p_n", "__il_shard")
    )
