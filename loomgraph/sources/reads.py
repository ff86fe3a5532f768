"""Point and range reads of snapshot tables: filters that reach the scan, in key order, one row past the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of a range read.
MAX_PREDICATES, MAX_ROWS = 64, 4096


def point(table: DataFrame, key: str) -> DataFrame:
    """The record of an id, or none."""
    return table.where(F.col("id") == key).limit(1)


def _range(rows: DataFrame, after: str | None, limit: int) -> DataFrame:
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit {limit}")
    rows = rows.where(F.col("id") > after) if after is not None else rows
    return rows.orderBy("id").limit(limit + 1)


def relation_range(relations: DataFrame, anchor: str, direction: str, predicates: list[str], after: str | None = None, limit: int = 100) -> DataFrame:
    """Relations out of (outgoing) or into (incoming) an entity; a row over ``limit`` says that there are more."""
    if not 1 <= len(predicates) <= MAX_PREDICATES:
        raise ValueError("predicates")
    near = {"outgoing": "subject", "incoming": "object"}[direction]
    return _range(relations.where((F.col(near) == anchor) & F.col("predicate").isin(*predicates)), after, limit)


def occurrence_range(occurrences: DataFrame, file: str, after: str | None = None, limit: int = 100) -> DataFrame:
    return _range(occurrences.where(F.col("file") == file), after, limit)


def coverage_range(coverage: DataFrame, scope_kind: str, scope_id: str, after: str | None = None, limit: int = 100) -> DataFrame:
    return _range(coverage.where((F.col("scope_kind") == scope_kind) & (F.col("scope_id") == scope_id)), after, limit)
