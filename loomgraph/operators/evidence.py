"""Evidence packs: ranking by built-in order, a sequential fill per pack, role coverage."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.budget import Budget, BudgetExceeded

# Roles by priority, roles each objective needs, and the bounds of a pack.
ROLES = ("definition", "implementation", "caller", "test", "risk", "architecture", "change")
REQUIRED = {
    "bug_fix": ("definition", "implementation", "caller", "test"),
    "refactor": ("definition", "caller", "test"),
    "explanation": ("definition", "architecture"),
    "migration": ("definition", "caller", "change"),
    "review": ("change", "definition", "risk"),
}
MAX_ITEMS, PER_PATH, PER_PROVIDER = 200, 2, 4
FIRST = {
    "balanced": (),
    "implementation": ("implementation",),
    "tests": ("test",),
    "impact": ("risk", "change", "caller"),
    "architecture": ("architecture", "caller"),
}


def rank_columns(objective: str, diversity: str = "balanced") -> list[Column]:
    """The order of candidates: anchors, required roles, the roles that ``diversity`` favours, priority, relevance, confidence, id."""
    first = FIRST[diversity]
    favoured = [*first, *[r for r in ROLES if r not in first]]
    at = lambda order: F.array_position(F.array(*[F.lit(r) for r in order]), F.col("role"))
    return [F.desc("anchor"), F.desc(F.col("role").isin(*REQUIRED[objective])), at(favoured), at(ROLES), F.desc("relevance"), F.desc("confidence"), F.col("id")]


def _reserved(rows: pd.DataFrame, objective: str, budget: int) -> np.ndarray:
    """A mask of what a pack holds whatever else comes: the cheapest anchors that fit, then the first of each required role."""
    held = np.zeros(len(rows), bool)
    anchors = rows[rows["anchor"]].sort_values(["tokens", "relevance", "confidence", "id"], ascending=[True, False, False, True])
    # Cheapest first, so those that fit are a prefix.
    fits = anchors["tokens"].cumsum() <= budget
    held[anchors.index[fits.to_numpy()][:MAX_ITEMS]] = True
    for role in REQUIRED[objective]:
        of_role = (rows["role"] == role).to_numpy()
        room = budget - rows["tokens"][held].sum()
        free = of_role & (rows["tokens"] <= room).to_numpy()
        if not held[of_role].any() and free.any() and held.sum() < MAX_ITEMS:
            held[free.argmax()] = True
    return held


def select_pack(rows: pd.DataFrame, objective: str, budget: int) -> pd.DataFrame:
    """One pack from ranked candidates: what ``_reserved`` holds, and in order whatever the limits and the budget still allow."""
    rows = rows.sort_values("position", ignore_index=True)
    held = _reserved(rows, objective, budget)
    room = budget - int(rows["tokens"][held].sum())
    to_come = held[::-1].cumsum()[::-1]
    quotas = {"path": PER_PATH, "provider": PER_PROVIDER, "place": 1}
    used, selected, outcome = Counter(), 0, []
    for row, is_held, later in zip(rows.itertuples(), held, to_come):
        keys = (("path", row.path), ("provider", row.provider), ("place", (row.path, row.region)))
        if is_held:
            verdict = "selected"
        elif selected + later >= MAX_ITEMS:
            verdict = "item_limit"
        elif any(used[k] >= quotas[k[0]] for k in keys):
            verdict = "diversity"
        else:
            verdict = "selected" if row.tokens <= room else "budget"
            room -= row.tokens if verdict == "selected" else 0
        if verdict == "selected":
            selected += 1
            used.update(keys)
        outcome.append(verdict)
    return rows.assign(outcome=outcome)[["pack", "position", "id", "role", "tokens", "outcome"]]


def pack_evidence(candidates: DataFrame, objective: str, budget: int, diversity: str = "balanced", bounds: Budget = Budget()) -> DataFrame:
    """(pack, position, id, role, tokens, outcome): selected, or why not. ``candidates``: pack, id, role, relevance,
    confidence, tokens, path, provider, region, anchor. The fill depends on what was taken before, so each pack
    is one group; a pack is a request of at most ``bounds.candidates``, and a larger one is refused."""
    if not candidates.groupBy("pack").count().where(F.col("count") > bounds.candidates).isEmpty():
        raise BudgetExceeded("candidates", bounds.candidates)
    ranked = candidates.withColumn("position", F.row_number().over(Window.partitionBy("pack").orderBy(*rank_columns(objective, diversity))))
    return ranked.groupBy("pack").applyInPandas(
        lambda rows: select_pack(rows, objective, budget), "pack string, position int, id string, role string, tokens long, outcome string"
    )


def role_coverage(packed: DataFrame, objective: str) -> DataFrame:
    """(pack, role, selected, observed, status) for every required role."""
    spark = packed.sparkSession
    need = spark.createDataFrame([(r,) for r in REQUIRED[objective]], "role string")
    packs = packed.select("pack").distinct()
    counts = packed.groupBy("pack", "role").agg(F.count_if(F.col("outcome") == "selected").alias("selected"), F.count(F.lit(1)).alias("observed"))
    j = packs.join(F.broadcast(need)).join(counts, ["pack", "role"], "left").fillna(0, ["selected", "observed"])
    status = F.when(F.col("selected") > 0, "covered").when(F.col("observed") > 0, "omitted").otherwise("not_observed")
    return j.withColumn("status", status)
