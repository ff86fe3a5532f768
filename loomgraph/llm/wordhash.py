"""Words, word hashes and hashes of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2 = np.uint64(29), np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def word_hash_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, the halves of one of 128 bits."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of 64-bit hashes."""
    x = left * _A
    x ^= right + _B
    x ^= x >> _S1
    x *= _M1
    x ^= x >> _S2
    x *= _M2
    x ^= x >> _S1
    return x


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-word windows: halves are joined by doubling, so any size takes a few steps."""
    if len(h) < size:
        return h[:0]
    at, width, out, done = h, 1, None, 0
    left = size
    while left:
        if left & 1:
            n = len(h) - size + 1
            piece = at[done : done + n]
            out = piece.copy() if out is None else mix(out, piece)
            done += width
        left >>= 1
        if left:
            at, width = mix(at[:-width], at[width:]), width * 2
    return out


def repeated(hashes: np.ndarray) -> np.ndarray:
    """A mask of the entries whose value occurs twice or more."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    mask = np.zeros(len(hashes), bool)
    mask[order[1:][same]] = True
    mask[order[:-1][same]] = True
    return mask


def covered(mask: np.ndarray, size: int, n: int) -> np.ndarray:
    """A mask of the ``n`` words that lie in a marked window of ``size`` words."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(mask)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def beyond_second(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mask of the entries whose pair (a, b) occurs at two earlier places already."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    first = np.ones(len(order), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    place = np.arange(len(order))
    mask = np.zeros(len(order), bool)
    mask[order] = place - np.maximum.accumulate(np.where(first, place, 0)) >= 2
    return mask
