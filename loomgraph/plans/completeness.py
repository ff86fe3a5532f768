"""How complete an answer is, and what may be claimed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Execution states from strong to weak, and coverage statuses.
STATES = ("complete", "truncated", "unsupported_partial", "indeterminate")
COVERAGE = ("complete", "bounded", "sampled", "unknown")
#: Claims that a witness supports, with a qualification; all others fall with any limitation.
WITNESSED = ("positive_witness", "ranking")


def claim_disposition(kind: Column, state: Column, coverage: Column) -> Column:
    """supported, qualified or inconclusive; a missing or unknown signal counts as a limitation."""
    limited = ~(F.coalesce(state, F.lit("indeterminate")) == "complete") | ~(F.coalesce(coverage, F.lit("unknown")) == "complete")
    return F.when(~limited, "supported").when(kind.isin(*WITNESSED), "qualified").otherwise("inconclusive")


def merge(parts: DataFrame, key: str) -> DataFrame:
    """(key, state, limiting, continuation) of several parts: the weakest state, all limits, continuation if every weak part has one.

    ``parts``: key, state, limiting (array), continuation (not_applicable, available, unavailable).
    """
    level = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    level = F.when(level == 0, len(STATES)).otherwise(level)
    # Limits one by one: a key of many parts has few different ones, so that is all it gathers.
    each = parts.select(key, level.alias("level"), "continuation", F.explode_outer("limiting").alias("limit"))
    out = each.groupBy(key).agg(
        F.max("level").alias("level"),
        F.array_join(F.sort_array(F.collect_set("limit")), ",").alias("limiting"),
        F.count_if(F.col("continuation") == "unavailable").alias("none"),
        F.count_if(F.col("continuation") == "available").alias("some"),
    )
    continuation = F.when(F.col("level") == 1, "not_applicable").when((F.col("none") > 0) | (F.col("some") == 0), "unavailable").otherwise("available")
    return out.select(key, F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("level").cast("int")).alias("state"), "limiting", continuation.alias("continuation"))
