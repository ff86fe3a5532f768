"""The catalogue of repositories: a searched, filtered list in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, folded


def list_catalog(
    entries: DataFrame, search: tuple[str, ...] = (), states: tuple[str, ...] = (), after: tuple[str, object] | None = None, limit: int = 20
) -> DataFrame:
    """(position, id, name, state, total, truncated): entries (id, name, state) by folded name, then id.

    ``search``: any of these strings in the folded name; ``states``: any of these. ``after`` is the (name,
    id) that the last page ended with. ``total`` counts all pages, ``truncated`` says that more follow.
    """
    rows = entries.select("id", "name", "state", folded("name").alias("key"))
    hit = F.lit(not search)
    for part in search:
        hit = hit | F.contains("key", F.lit(fold(part)))
    rows = rows.where(hit & (F.col("state").isin(*states) if states else F.lit(True)))
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    if after:
        name, id_ = fold(after[0]), F.lit(after[1])
        rows = rows.where((F.col("key") > name) | ((F.col("key") == name) & (F.col("id") > id_)))
    page = rows.orderBy("key", "id").limit(limit + 1)
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy("key", "id")).cast("long"))
    over = numbered.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    out = numbered.where(F.col("position") <= limit).join(F.broadcast(total)).join(F.broadcast(over))
    return out.select("position", "id", "name", "state", "total", "truncated")
