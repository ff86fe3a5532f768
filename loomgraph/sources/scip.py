"""Index files of the public SCIP format as frames, and back.

The protobuf wire format is read and written here, message by message; only the fields below are
kept. One index is one record: its documents are exploded on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the format's messages, and bits of symbol roles.
INDEX_DOCUMENTS = 2
DOCUMENT = {"path": 1, "occurrences": 2, "symbols": 3, "language": 4}
OCCURRENCE = {"range": 1, "symbol": 2, "roles": 3}
SYMBOL = {"symbol": 1, "relationships": 4, "kind": 5, "name": 6, "enclosing": 8}
RELATIONSHIP = {"symbol": 1, "is_reference": 2, "is_implementation": 3, "is_type_definition": 4}
ROLE_BITS = {"definition": 1, "import_use": 2, "write": 4, "read": 8}

MAX_INDEX_BYTES = 512 << 20
SCHEMA = (
    "path string, language string, occurrences array<struct<symbol:string,roles:int,range:array<int>>>, "
    "symbols array<struct<symbol:string,name:string,kind:int,enclosing:string,relationships:array<struct<symbol:string,kind:string>>>>"
)


class ScipRejected(ValueError):
    pass


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ScipRejected("broken varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as int, length-delimited as bytes; fixed widths are skipped."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield number, value
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ScipRejected("truncated field")
            yield number, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ScipRejected(f"wire type {kind}")


def _ints(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def _text(message: dict, name: str) -> str:
    return message.get(name, b"").decode("utf-8", "replace")


def _single(data: bytes, names: dict[str, int]) -> dict:
    by = {n: k for k, n in names.items()}
    return {by[n]: v for n, v in fields(data) if n in by}


def decode_document(data: bytes) -> dict:
    out: dict = {"path": "", "language": "", "occurrences": [], "symbols": []}
    for number, value in fields(data):
        if number == DOCUMENT["path"]:
            out["path"] = value.decode("utf-8", "replace")
        elif number == DOCUMENT["language"]:
            out["language"] = value.decode("utf-8", "replace").lower()
        elif number == DOCUMENT["occurrences"]:
            ranges = [x for n, v in fields(value) if n == OCCURRENCE["range"] for x in _ints(v)]
            m = _single(value, OCCURRENCE)
            out["occurrences"].append({"symbol": _text(m, "symbol"), "roles": m.get("roles", 0), "range": ranges})
        elif number == DOCUMENT["symbols"]:
            m = _single(value, SYMBOL)
            relations = []
            for n, v in fields(value):
                if n == SYMBOL["relationships"]:
                    r = _single(v, RELATIONSHIP)
                    kind = next((k[3:] for k in ("is_implementation", "is_type_definition", "is_reference") if r.get(k)), "reference")
                    relations.append({"symbol": _text(r, "symbol"), "kind": kind})
            out["symbols"].append({"symbol": _text(m, "symbol"), "name": _text(m, "name"), "kind": m.get("kind", 0), "enclosing": _text(m, "enclosing"), "relationships": relations})
    return out


def _put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _put(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _put_varint(number << 3) + _put_varint(value) if value else b""
    raw = value.encode() if isinstance(value, str) else value
    return _put_varint(number << 3 | 2) + _put_varint(len(raw)) + raw if raw else b""


def encode_document(row: dict) -> bytes:
    out = _put(DOCUMENT["path"], row["path"] or "") + _put(DOCUMENT["language"], row["language"] or "")
    for o in row["occurrences"] if row["occurrences"] is not None else ():
        packed = b"".join(map(_put_varint, map(int, o["range"])))
        out += _put(DOCUMENT["occurrences"], _put(OCCURRENCE["range"], packed) + _put(OCCURRENCE["symbol"], o["symbol"]) + _put(OCCURRENCE["roles"], int(o["roles"])))
    for s in row["symbols"] if row["symbols"] is not None else ():
        body = _put(SYMBOL["symbol"], s["symbol"])
        for r in s["relationships"] if s["relationships"] is not None else ():
            body += _put(SYMBOL["relationships"], _put(RELATIONSHIP["symbol"], r["symbol"]) + _put(RELATIONSHIP[f"is_{r['kind']}"], 1))
        body += _put(SYMBOL["kind"], int(s["kind"])) + _put(SYMBOL["name"], s["name"] or "") + _put(SYMBOL["enclosing"], s["enclosing"] or "")
        out += _put(DOCUMENT["symbols"], body)
    return out


#: Documents that one frame of the reader holds.
_READ_ROWS = 256


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, occurrences, symbols): a row for each document of the index files at ``path``.

    A file over ``MAX_INDEX_BYTES`` is refused, not left out.
    """
    raw = spark.read.format("binaryFile").load(path)
    large = raw.where(F.col("length") > MAX_INDEX_BYTES).select("path").limit(1).collect()
    if large:
        raise ScipRejected(f"{large[0]['path']} is over {MAX_INDEX_BYTES} bytes")

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                documents = (value for number, value in fields(bytes(content)) if number == INDEX_DOCUMENTS)
                while some := list(islice(documents, _READ_ROWS)):
                    yield pd.DataFrame({"document": some})

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([decode_document(bytes(d)) for d in part["document"]], columns=["path", "language", "occurrences", "symbols"])

    return raw.select("content").mapInPandas(split, "document binary").mapInPandas(decode, SCHEMA)


def to_facts(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, occurrences and relations of the model from ``read_scip``."""
    s = documents.select("path", "language", F.explode("symbols").alias("s"))
    entities = s.select(
        F.col("s.symbol").alias("id"), F.lit("external_symbol").alias("kind"), F.col("s.name").alias("name"), F.col("s.symbol").alias("qualified_name"),
        F.when(F.col("s.enclosing") != "", F.col("s.enclosing")).alias("container_id"), F.lit("public").alias("visibility"), F.lit("A").alias("tier"), "language", "path",
    ).dropDuplicates(["id"])
    o = documents.select("path", "language", F.posexplode("occurrences").alias("k", "o"))
    role = F.lit("reference")
    for name in ("read", "write", "import_use", "definition"):
        role = F.when(F.col("o.roles").bitwiseAND(ROLE_BITS[name]) != 0, name).otherwise(role)
    occurrences = o.select(F.concat("path", F.lit("#"), "k").alias("id"), "path", "language", role.alias("role"), F.col("o.symbol").alias("symbol"), F.col("o.range")[0].alias("line"), F.col("o.range")[1].alias("column"))
    predicate = F.create_map(*[F.lit(x) for p in (("implementation", "implements"), ("type_definition", "uses_type"), ("reference", "refers_to")) for x in p])
    r = s.select(F.col("s.symbol").alias("subject"), F.explode("s.relationships").alias("r"))
    relations = r.select("subject", predicate[F.col("r.kind")].alias("predicate"), F.col("r.symbol").alias("object"), F.lit(1000).alias("confidence"))
    return entities, occurrences, relations


def write_scip(documents: DataFrame, path: str) -> None:
    """One index file a task below ``path``: concatenated messages of one type are one message."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [_put(INDEX_DOCUMENTS, encode_document(r)) for r in part.to_dict("records")]
            yield pd.DataFrame({"document": out})

    documents.select("path", "language", "occurrences", "symbols").mapInPandas(encode, "document binary").write.parquet(path)


def export_index(documents: DataFrame, path: str) -> bytes:
    """The bytes of one index, for a caller that hands it on; bounded by ``MAX_INDEX_BYTES``."""
    write_scip(documents, path)
    rows = documents.sparkSession.read.parquet(path)
    if (rows.agg(F.sum(F.octet_length("document"))).first()[0] or 0) > MAX_INDEX_BYTES:
        raise ScipRejected("the index is too large for one file")
    return b"".join(bytes(r[0]) for r in rows.collect())
