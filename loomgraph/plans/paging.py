"""Keyset pages with one row more than asked for, exact totals and signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CursorRejected(ValueError):
    pass


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    truncated: bool
    last: object


def page(df: DataFrame, key: str, limit: int, after=None) -> Page:
    """The next ``limit`` rows by ``key`` (unique) after a given one; the total counts all rows."""
    rest = df.where(F.col(key) > F.lit(after)) if after is not None else df
    keys = [r[0] for r in rest.select(key).orderBy(key).limit(limit + 1).collect()]
    shown = keys[:limit]
    rows = rest.where(F.col(key) <= F.lit(shown[-1])).orderBy(key) if shown else rest.limit(0)
    return Page(rows, df.count(), len(keys) > limit, shown[-1] if shown else None)


def page_frame(df: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """The page as one frame, each row with ``total`` and ``truncated``; everything in one job."""
    totals = df.agg(F.count(F.lit(1)).alias("total"))
    rest = df.where(F.col(key) > F.lit(after)) if after is not None else df
    left = rest.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return rest.orderBy(key).limit(limit).join(F.broadcast(totals)).join(F.broadcast(left))  # one row each


def _sign(body: bytes, key: bytes) -> bytes:
    return hmac.new(key, body, hashlib.sha256).digest()


def issue_cursor(binding: dict, last, key: bytes, ttl: int = 900, now: float | None = None) -> str:
    """A cursor bound to what ``binding`` names (snapshot, tool, query, page size)."""
    body = json.dumps({"b": binding, "l": last, "e": int((time.time() if now is None else now) + ttl)}, sort_keys=True).encode()
    return base64.urlsafe_b64encode(_sign(body, key) + body).decode()


def open_cursor(cursor: str, binding: dict, key: bytes, now: float | None = None):
    """The key after which to go on; raises CursorRejected if forged, expired or of another query."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
    except ValueError as e:
        raise CursorRejected("malformed") from e
    tag, body = raw[:32], raw[32:]
    if not hmac.compare_digest(tag, _sign(body, key)):
        raise CursorRejected("tampered")
    found = json.loads(body)
    if found["b"] != binding:
        raise CursorRejected("other_query")
    if found["e"] < (time.time() if now is None else now):
        raise CursorRejected("expired")
    return found["l"]
