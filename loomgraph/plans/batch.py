"""Batches of dependent operations over lazily evaluated frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of a batch.
MAX_OPERATIONS, MAX_DEPTH, MAX_DEPENDENCIES = 16, 8, 8


class BatchRejected(ValueError):
    pass


@dataclass(frozen=True)
class Operation:
    """``run`` takes the frames of ``after`` by name; ``tool`` is its label."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    tool: str = ""


@dataclass
class Outcome:
    frames: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def order(operations: list[Operation]) -> list[Operation]:
    """A running order, operations that are ready together in the order given; checks the bounds."""
    names = [o.name for o in operations]
    if not 1 <= len(operations) <= MAX_OPERATIONS or len(set(names)) != len(names):
        raise BatchRejected("operations")
    if any(len(o.after) > MAX_DEPENDENCIES or not set(o.after) <= set(names) for o in operations):
        raise BatchRejected("dependencies")
    if any(o.tool in ("query.batch", "history.compare", "query.advanced") for o in operations):
        raise BatchRejected("nested")
    depth: dict[str, int] = {}
    left, out = list(operations), []
    while left:
        ready = [o for o in left if all(a in depth for a in o.after)]
        if not ready:
            raise BatchRejected("cycle")
        for o in ready:
            depth[o.name] = 1 + max((depth[a] for a in o.after), default=0)
            if depth[o.name] > MAX_DEPTH:
                raise BatchRejected("depth")
        out += ready
        left = [o for o in left if o.name not in depth]
    return out


def run(operations: list[Operation], fail_fast: bool = False) -> Outcome:
    """Every frame that could be planned; what depends on a failure is skipped, the rest goes on unless ``fail_fast``."""
    out = Outcome()
    for o in order(operations):
        if (fail_fast and out.failed) or any(a not in out.frames for a in o.after):
            out.skipped.append(o.name)
            continue
        try:
            out.frames[o.name] = o.run({a: out.frames[a] for a in o.after})
        except ValueError as e:  # a rejected request; engine errors are not swallowed
            out.failed[o.name] = str(e)
    return out


def summary(outcome: Outcome) -> DataFrame:
    """(operation, rows) of each frame, counted by one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("operation"), "rows") for n, df in outcome.frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
