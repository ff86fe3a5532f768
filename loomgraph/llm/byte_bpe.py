"""Byte-level BPE encoding and decoding by monoid tree reduction.

Tokens of a text form a monoid element; two neighbours are joined by re-encoding a window around
their boundary. Merging picks the pair of lowest rank, leftmost first, so inside any span that no
merge leaves, it runs as it would on the span alone. Hence a token sequence is the encoding of its
bytes exactly if every two neighbours, encoded together, stay as they are: the first merge that
crossed a boundary would cross it in that pair alone too. A join is therefore proven right once the
pairs at the window's two ends and those inside it are stable; until then the window grows, and what
it spans is merged anew. Leaves are of ``LEAF_BYTES``, so the tree works inside ordinary words.

Above the matches of the pattern the tree goes on: no merge crosses the end of a match, so there the
join is concatenation. Decoding is the same tree over identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BoundedCache, held, map_batches, raw_texts

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_S = " \\t\\n\\r\\x0b\\x0c"
#: Texts without other characters split alike under any Unicode version.
_PLAIN = re.compile(rf"[^\t-\r\x20-\x7e{_LETTERS}‐-‧€¡«°»¿]")
_QUICK = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_S}0-9{_LETTERS}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
LEAF_BYTES = 4
#: Spans up to this are merged by scanning.
SCAN_BYTES = 64
_NONE = 1 << 60
#: Matches, and identifiers, that one leaf of the upper tree and of the decoding tree holds.
PIECE_LEAF, DECODE_LEAF = 8, 8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _up(level: list[bytes]) -> bytes:
    """The concatenation of ``level``, neighbours joined pair by pair up a balanced tree."""
    while len(level) > 1:
        odd = level[-1:] if len(level) % 2 else []
        level = [a + b for a, b in zip(level[::2], level[1::2])] + odd
    return level[0] if level else b""


class TreeCodec:
    """``joins`` counts the tree's inner nodes below the matches, ``regrown`` the windows that had to be merged anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.joins = self.regrown = 0
        self._full = regex.compile(pattern)
        self._span = BoundedCache(self._merge)  # leaves, windows and pairs come again and again
        self._piece = BoundedCache(lambda p: packed(self.encode_piece(p.encode())))

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain merging of a span: the adjacent pair of lowest rank, leftmost of equals, until none is left.

        Short spans find that pair by looking at all, long ones by a heap.
        """
        get, n = self.ranks.get, len(data)
        if n <= SCAN_BYTES:
            parts = [data[i : i + 1] for i in range(n)]
            pairs = [get(data[i : i + 2], _NONE) for i in range(n - 1)]
            while pairs and (best := min(pairs)) != _NONE:
                i = pairs.index(best)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(parts[i] + parts[i + 1], _NONE)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            return parts
        end = list(range(1, n + 1))  # of the part that starts here; 0: none starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != k:  # one side has been merged since
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                if (r := get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := get(data[h:k])) is not None:
                heapq.heappush(heap, (r, h, k))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = end[i]
        return out

    def _stable(self, x: bytes, y: bytes) -> bool:
        """Whether two neighbours, encoded together, stay as they are."""
        both = self._span[x + y]
        return len(both) == 2 and both[0] == x

    def _join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        self.joins += 1
        if self._stable(left[-1], right[0]):
            return left + right
        n, m, grow = len(left), len(right), 1
        while True:  # the window is the last and the first ``grow`` tokens, merged anew: stable inside
            a, b = max(0, n - grow), min(m, grow)
            middle = self._span[b"".join(left[a:]) + b"".join(right[:b])]
            self.regrown += 1
            if (not a or self._stable(left[a - 1], middle[0])) and (b == m or self._stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            grow *= 2

    def _tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF_BYTES:
            return self._span[data]
        half = len(data) // 2
        return self._join(self._tree(data[:half]), self._tree(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """Identifiers of one match of the pattern; a match that is a token itself is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else [self.ranks[t] for t in self._tree(data)]

    def split(self, text: str) -> list[str]:
        return _QUICK.findall(text) if _PLAIN.search(text) is None else self._full.findall(text)

    def encode_bytes(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers."""
        leaves = list(map(self._piece.__getitem__, self.split(text)))
        return _up([b"".join(leaves[i : i + PIECE_LEAF]) for i in range(0, len(leaves), PIECE_LEAF)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of all identifiers, concatenated up the tree."""
        parts = list(map(self.tokens.__getitem__, ids))
        return _up([b"".join(parts[i : i + DECODE_LEAF]) for i in range(0, len(parts), DECODE_LEAF)])


def encode_documents(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """One row per document: n_tokens, and ids (array<long>) with decoded (string), or with ``digests`` their SHA-256.

    Each match of ``pattern`` is encoded separately, without special tokens. No shuffle; a worker
    keeps a bounded cache of the pieces it has seen.

    Null text: as empty, no tokens. Very long texts are encoded whole, in memory of a few times their
    size; a match of any length takes time in proportion to it. Repeated rows: a row each. Null ids
    stay null. Empty table: no rows. Other input columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"

    def make():
        codec = held(("byte_bpe", vocabulary, pattern), lambda: TreeCodec(load_ranks(vocabulary), pattern))

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, first, second = [], [], []
            for raw in raw_texts(batch.column(1)):
                packed = codec.encode_bytes((raw or b"").decode())
                ids = np.frombuffer(packed, "<u4").tolist()
                back = codec.decode(ids)
                counts.append(len(ids))
                first.append(hashlib.sha256(packed).hexdigest() if digests else ids)
                second.append(hashlib.sha256(back).hexdigest() if digests else back.decode())
            cols = [pa.array(counts, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int64())), pa.array(second, pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "n_tokens", *[x.split()[0] for x in tail.split(", ")]])

        return kernel

    return map_batches(df.select(id_col, text_col), make, f"{id_col} {id_type}, n_tokens long, {tail}")
