"""Budgets that fail closed: an answer over its bound is refused, never cut in silence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


class BudgetExceeded(RuntimeError):
    def __init__(self, resource: str, bound: int):
        super().__init__(f"over {bound} {resource}")
        self.resource, self.bound = resource, bound


@dataclass(frozen=True)
class Budget:
    """The default bounds of one interactive query."""

    rows: int = 250_000
    edges: int = 100_000
    results: int = 1_000
    candidates: int = 10_000


def guard(df: DataFrame, resource: str, budget: Budget = Budget()) -> DataFrame:
    """``df`` if it has no more rows than the budget's ``resource``; one row over is enough to tell."""
    bound = getattr(budget, resource)
    if df.limit(bound + 1).count() > bound:
        raise BudgetExceeded(resource, bound)
    return df


@dataclass(frozen=True)
class VectorBinding:
    """What a vector table was made from; queries must name the same."""

    repository: str
    generation: str
    model: str
    model_hash: str
    chunk_policy: str

    def check(self, other: VectorBinding) -> None:
        wrong = [k for k in self.__dataclass_fields__ if getattr(self, k) != getattr(other, k)]
        if wrong:
            raise ValueError(f"another {', '.join(wrong)}")
