"""Alignment of two tokenizers' tokens by byte-owner arrays."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Numbered, from_planes, map_blocks, planes, ragged, rows, sums
from .bpe_words import PLAIN, byte_symbols
from .common import held, materialize, raw_texts

#: White space beside the space and the line feed; a text that has none, and no two of these side by side, can be split plainly.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A space between characters that are none: neither vocabulary has a token that goes on beyond its left side.
_SPACE = re.compile(r" (?<=\S )(?=\S)")
#: Fixed value: how byte-level files split a text.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Bytes of segments that are aligned at once, the links of a group up to which all are listed, and the links looked at together while their documents are counted.
_BYTES, _LARGE, _LINKS = 1 << 17, 4096, 1 << 19
#: Bytes of text of a block: a worker holds its segments, their tokens and their links at once.
BLOCK_BYTES = 5 << 20
#: Bytes of tokens of segments that a worker keeps for its next blocks.
RECENT_BYTES = 64 << 20


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte the token that owns it."""
    return np.repeat(np.arange(len(lengths)), lengths)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token places (i, j) of A and B that share bytes, from their byte owners: the consecutive distinct owner pairs."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each byte its group: groups part where both owners change at once."""
    both = np.zeros(len(a), np.int64)
    both[1:] = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    return np.cumsum(both)


class Recent:
    """Values of keys used lately: two generations of ``limit`` bytes together, the older of which goes as a whole."""

    def __init__(self, limit: int):
        self._half, self._new, self._old, self._used = limit // 2, {}, {}, 0

    def take(self, keys: list[str], make) -> list:
        """The value of each key; ``make`` gives those of a list of keys that are not held."""
        found = [self._new.get(k) or self._old.get(k) for k in keys]
        missing = [k for k, v in zip(keys, found) if v is None]
        made = iter(make(missing) if missing else [])
        found = [v or next(made) for v in found]
        for k, v in zip(keys, found):
            if k not in self._new and len(k) < 256:
                if self._used > self._half:
                    self._new, self._old, self._used = {}, self._new, 0
                self._new[k] = v
                self._used += 320 + len(k) + len(v[0]) + len(v[1])
        return found


@dataclass
class Aligned:
    """Segments' figures (n_a, n_b, n_groups, n_links, n_overlaps by row), their groups as text (None where bytes are not kept), and their links.

    Segment k has the links ``sizes[k]`` from ``starts[k]``: id pairs a << 32 | b, and how often each counts.
    """

    figures: np.ndarray
    groups: list[str | None]
    starts: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    """Two vocabularies, their tokens' bytes, and the alignment of segments."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as f:
            raw = json.load(f)
        vocab = raw["model"]["vocab"] | {t["content"]: t["id"] for t in raw["added_tokens"]}
        own = {s: b for b, s in enumerate(byte_symbols())}
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(own.__getitem__, token)) if all(c in own for c in token) else token.encode()
        piece = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes.fromhex(m[1]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in piece]
        if any(re.search("[^▁]▁", p) for p in piece):
            raise ValueError(f"{pieces} has pieces that go on after a space; texts can't be cut there")
        self.quick = self._by_ranks(raw)
        self.recent = Recent(RECENT_BYTES)
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        # Each id as text, with what may stand after it in a list of groups.
        self.said = {sign: np.array([f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object) for sign in ",|;\n"}

    def segments(self, text: str) -> list[str]:
        """``text`` cut at single spaces; each segment stands for itself with a space before it, which B adds."""
        plain = text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text
        return text.split(" ") if plain and not _RARE.search(text) else _SPACE.split(text)

    def align(self, segments: list[str]) -> Aligned:
        """All ``segments``, so many at once as ``_BYTES`` allow, or one."""
        parts, was, size = [], 0, 0
        for k, segment in enumerate(segments):
            size += len(segment) + 1
            if size > _BYTES and k > was:
                parts.append(self._align(segments[was:k]))
                was, size = k, len(segment) + 1
        parts.append(self._align(segments[was:]))
        sizes = np.concatenate([x.sizes for x in parts])
        return Aligned(
            np.concatenate([x.figures for x in parts], axis=1), [g for x in parts for g in x.groups], np.cumsum(sizes) - sizes, sizes, np.concatenate([x.pairs for x in parts]), np.concatenate([x.times for x in parts])
        )

    def _align(self, segments: list[str]) -> Aligned:
        tokens = self.recent.take(segments, self._encode)
        raw = [b" " + s.encode() for s in segments]
        if not self._kept(raw, tokens):
            good = [self._kept([r], [t]) for r, t in zip(raw, tokens)]
            part = self._align([s for s, ok in zip(segments, good) if ok])
            figures, sizes, at = np.zeros((5, len(segments)), np.int64), np.zeros(len(segments), np.int64), np.flatnonzero(good)
            figures[:, at], sizes[at] = part.figures, part.sizes
            said = iter(part.groups)
            return Aligned(figures, [next(said) if ok else None for ok in good], np.cumsum(sizes) - sizes, sizes, part.pairs, part.times)
        return self._linked(tokens)

    def _by_ranks(self, raw: dict):
        """An encoder of texts of plain characters by ranks, where the file's merges have them: three times as fast, with the same tokens."""
        import tiktoken

        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in raw["model"]["merges"]]
        split = raw["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not raw["normalizer"]
        if not plain or any(raw["model"]["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, segments: list[str]) -> list[tuple[bytes, bytes]]:
        a: list = [None] * len(segments)
        rest = range(len(segments))
        if self.quick:
            rest = [k for k in rest if PLAIN.search(segments[k])]
            odd = set(rest)
            a = [None if k in odd else self.quick(" " + s) for k, s in enumerate(segments)]
        for k, x in zip(rest, self.a.encode_batch_fast([" " + segments[k] for k in rest], add_special_tokens=False)):
            a[k] = x.ids
        return [(array("I", x).tobytes(), array("I", y).tobytes()) for x, y in zip(a, self.b.encode(segments, num_threads=1))]

    def _ids(self, tokens: list[tuple[bytes, bytes]], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all segments, number of each)."""
        own = [t[side] for t in tokens]
        return np.frombuffer(b"".join(own), np.uint32).astype(np.int64), np.array(list(map(len, own)), np.int64) // 4

    def _kept(self, raw: list[bytes], tokens: list[tuple[bytes, bytes]]) -> bool:
        """Whether the tokens of every segment join to its bytes."""
        sizes, whole = np.array(list(map(len, raw)), np.int64), b"".join(raw)
        for side, own in enumerate((self.a_bytes, self.b_bytes)):
            ids, n = self._ids(tokens, side)
            if (sums(self.lengths[side][ids], n) != sizes).any() or b"".join(map(own.__getitem__, ids.tolist())) != whole:
                return False
        return True

    def _linked(self, tokens: list[tuple[bytes, bytes]]) -> Aligned:
        """Owners, overlaps, cuts and links over the bytes of all segments, one after the other; between two both tokens end."""
        n = len(tokens)
        (a, n_a), (b, n_b) = self._ids(tokens, 0), self._ids(tokens, 1)
        seg_a, seg_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        own_a, own_b = owners(self.lengths[0][a]), owners(self.lengths[1][b])
        group, (over, _) = cuts(own_a, own_b), overlaps(own_a, own_b)
        of_a, of_b = (group[np.cumsum(x) - x] if len(x) else x for x in (self.lengths[0][a], self.lengths[1][b]))
        m = int(group[-1]) + 1 if len(group) else 0
        in_a, in_b = np.bincount(of_a, minlength=m), np.bincount(of_b, minlength=m)
        ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
        seg_g = seg_a[ends_a - in_a] if m else seg_a
        figures = np.stack([np.bincount(seg_a, minlength=n), np.bincount(seg_b, minlength=n), np.bincount(seg_g, minlength=n), np.bincount(seg_g, in_a * in_b, n).astype(np.int64), np.bincount(seg_a[over], minlength=n)])
        # A group's tokens of A, then those of B, each with the sign that follows it.
        text = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ends_a - 1] = last_b[ends_b - 1] = True
        ends = np.zeros(m, bool)
        ends[np.cumsum(figures[2])[figures[2] > 0] - 1] = True
        text[np.arange(len(a)) + (ends_b - in_b)[of_a]] = np.where(last_a, self.said["|"][a], self.said[","][a])
        after = np.where(ends[of_b], self.said["\n"][b], self.said[";"][b])
        text[np.arange(len(b)) + ends_a[of_b]] = np.where(last_b, after, self.said[","][b])
        groups = "".join(text).split("\n")[:-1]
        # Links: each token of A with all of B in its group; of large groups the different pairs, counted.
        small = in_a * in_b <= _LARGE
        own = np.flatnonzero(small[of_a])
        width = in_b[of_a[own]]
        pairs = [np.repeat(a[own], width) << 32 | b[ragged((ends_b - in_b)[of_a[own]], width)]]
        times, seg = [np.ones(len(pairs[0]), np.int64)], [np.repeat(seg_a[own], width)]
        for g in np.flatnonzero(~small).tolist():
            found, counts = counted(a[ends_a[g] - in_a[g] : ends_a[g]], b[ends_b[g] - in_b[g] : ends_b[g]])
            pairs.append(found)
            times.append(counts)
            seg.append(np.full(len(found), seg_g[g]))
        seg = np.concatenate(seg)
        order = np.argsort(seg, kind="stable") if len(pairs) > 1 else slice(None)
        sizes = np.bincount(seg, minlength=n)
        return Aligned(figures, groups, np.cumsum(sizes) - sizes, sizes, np.concatenate(pairs)[order], np.concatenate(times)[order])


def counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different id pairs of one group, and their links."""
    x, n = np.unique(left, return_counts=True)
    y, m = np.unique(right, return_counts=True)
    return (x[:, None] << 32 | y).ravel(), (n[:, None] * m).ravel()


def _holders(texts: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` id pairs, the number of texts (arrays of their segments) that hold it; segment k has the pairs ``own[starts[k]:][:sizes[k]]``."""
    found = np.zeros(n, np.int64)
    part, links = [], 0
    for k, segments in enumerate(texts):
        segments = np.unique(segments)
        part.append(segments)
        links += int(sizes[segments].sum())
        if links < _LINKS and k + 1 < len(texts):
            continue
        flat = np.concatenate(part)
        which = np.repeat(np.arange(len(part)), [int(sizes[s].sum()) for s in part])
        keys = np.unique(which * n + own[ragged(starts[flat], sizes[flat])])
        found += np.bincount(keys % n, minlength=n) if n else 0
        part, links = [], 0
    return found


def align_tokenizers(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: how its tokens of A (``byte_level``, of a space and the text) and of B (``pieces``, of the text) lie on each other.

    n_a, n_b: tokens; n_groups: parts between byte offsets where tokens of both end; n_links: pairs of
    an A and a B token within a group; n_overlaps: those that share bytes; n_best: links whose id pair is linked in as many documents of the
    corpus as any pair of its A id; count_sum: these document counts summed over the links;
    groups_sha256 of the groups' ids as text; aligned: whether it has tokens.

    Texts are cut at single spaces, where both vocabularies always end a token. Each different segment
    of a block (a batch of texts, bounded in bytes) is aligned once, many side by side: its bytes' owners in A and B give
    overlaps and cuts. A block sends each of its id pairs once, with the number of its documents that
    hold it; what comes back is the pair's count in the corpus. So a pair that a third of all documents
    hold is a row a block, and texts are read once.

    Null and empty texts, and those whose bytes either vocabulary does not keep: zeros, and an empty
    groups_sha256. Very long texts are aligned whole; a group of them is counted by its different ids.
    Repeated rows: a row each, counted each. Null ids stay null. Empty table: no rows. Other input
    columns are not read.
    """
    id_field = df.select(id_col).schema[0]
    numbers = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long"
    schema = f"block long, id {id_field.dataType.simpleString()}, {numbers}, groups_sha256 string, segments binary, starts binary, links binary, pair long, place int, docs long"

    def make():
        aligner = held(("alignment", byte_level, pieces), lambda: Aligner(byte_level, pieces))

        def kernel(batch: pa.RecordBatch, block: int):
            numbers = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
            out = pa.schema([pa.field("block", pa.int64()), pa.field("id", batch.column(0).type)] + [pa.field(c, pa.int64()) for c in numbers] + [pa.field("groups_sha256", pa.string())] + [pa.field(c, pa.binary()) for c in ("segments", "starts", "links")] + [pa.field("pair", pa.int64()), pa.field("place", pa.int32()), pa.field("docs", pa.int64())])
            number = Numbered()
            texts = [[number[s] for s in aligner.segments(raw.decode())] if raw else [] for raw in raw_texts(batch.column(1))]
            known = aligner.align(number.keys_in_order)
            bad = {k for k, g in enumerate(known.groups) if g is None}
            texts = [t if not bad or bad.isdisjoint(t) else [] for t in texts]
            said = known.groups
            digests = [hashlib.sha256(";".join([said[k] for k in t]).encode()).hexdigest() if t else "" for t in texts]
            texts = [np.array(t, np.uint32) for t in texts]
            pairs, place = np.unique(known.pairs, return_inverse=True)
            flat, lengths = np.concatenate(texts), np.array(list(map(len, texts)), np.int64)
            figures = {c: pa.array(sums(own[flat], lengths)) for c, own in zip(numbers, known.figures)}
            yield rows(out, len(texts), block=[block] * len(texts), id=batch.column(0), groups_sha256=digests, segments=list(map(planes, texts)), **figures)
            yield rows(out, 1, block=[block], starts=[np.append(known.starts, len(place)).tobytes()], links=[np.stack([place, known.times]).astype(np.int64).tobytes()])
            docs = _holders([t for t in texts if len(t)], known.starts, known.sizes, place, len(pairs))
            found = np.flatnonzero(docs)
            yield rows(out, len(found), block=np.full(len(found), block), pair=pairs[found], place=found.astype(np.int32), docs=docs[found])

        return kernel

    table = materialize(map_blocks(df.select(id_col, text_col), make, schema, BLOCK_BYTES), "alignment-blocks", "zstd")
    own = table.where("pair IS NOT NULL").select(F.col("block").alias("of_block"), "pair", "place", "docs")
    counts = own.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = own.join(counts, "pair").select("of_block", "place", "n", "best")
    texts = table.where("pair IS NULL").drop("pair", "place", "docs")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lead = left.filter(pa.compute.is_valid(left["links"]))
        starts = np.frombuffer(lead["starts"][0].as_py(), np.int64)
        place, links = np.frombuffer(lead["links"][0].as_py(), np.int64).reshape(2, -1)
        at = right["place"].to_numpy()
        n, best = np.zeros(place.max(initial=-1) + 1, np.int64), np.zeros(place.max(initial=-1) + 1, np.int64)
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        docs = left.filter(pa.compute.is_valid(left["segments"]))
        segments = list(map(from_planes, docs["segments"].to_pylist()))
        flat, lengths = np.concatenate(segments), np.array(list(map(len, segments)), np.int64)
        of_pairs = [sums(sums(links * x[place], np.diff(starts))[flat], lengths) for x in (best, n)]
        return pa.table(
            [docs["id"], *(docs[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")), *map(pa.array, of_pairs), docs["groups_sha256"], pa.array(lengths > 0)],
            names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256", "aligned"],
        )

    done = f"`{id_col}` {id_field.dataType.simpleString()}, {numbers}, n_best long, count_sum long, groups_sha256 string, aligned boolean"
    return texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(finish, done)
