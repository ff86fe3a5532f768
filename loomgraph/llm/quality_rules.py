"""Quality rules by repetition coverage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl, map_batches, raw_texts
from .wordhash import covered, repeated, window_hashes, word_hashes

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares, in percent of a document's word characters, that a kept document may reach.

    Base counts words inside repeated 3-grams, up to half of a text; the limits on longer n-grams are
    far lower, so they reject texts that base lets pass.
    """

    min_words: int = 50
    max_repeat_words_pct: int = 50
    #: n-gram length in words -> largest percentage of characters inside n-grams found twice or more
    max_ngram_chars_pct: tuple[tuple[int, int], ...] = ((5, 15), (8, 12), (10, 10))
    #: largest percentage of characters inside lines equal to an earlier line
    max_dup_line_chars_pct: int = 20


SCHEMA_TAIL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"
)


def _measure(rules: RepetitionRules):
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True

    def chars(raw: bytes) -> int:
        return len(raw) if raw.isascii() else len(raw.decode())

    def measure(raw: bytes | None):
        raw = raw or b""
        words = raw.split()  # of bytes: exactly the six ASCII spaces
        n = len(words)
        n_symbols = int(symbols[np.frombuffer(raw, np.uint8)].sum()) if raw else 0
        lines, seen, dup_lines, dup_line_chars = raw.split(b"\n"), set(), 0, 0
        for line in lines:
            own = line.split()
            if own:
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += chars(b"".join(own))
                else:
                    seen.add(line)
        sizes = np.fromiter(map(len, words) if raw.isascii() else map(chars, words), np.int64, n)
        total = int(sizes.sum())
        h = word_hashes(words)

        def coverage(size: int) -> np.ndarray:
            if n < size:
                return np.zeros(n, bool)
            return covered(repeated(window_hashes(h, size)), size, n)

        three = coverage(3)
        repeat_words = int(three.sum())
        # Without a repeated 3-gram no longer one repeats either.
        dup_chars = [int(sizes[coverage(size)].sum()) if repeat_words or size < 3 else 0 for size, _ in rules.max_ngram_chars_pct]
        base_failed = n < rules.min_words or 100 * repeat_words > rules.max_repeat_words_pct * n
        kept = (
            not base_failed
            and all(100 * c <= pct * total for c, (_, pct) in zip(dup_chars, rules.max_ngram_chars_pct))
            and 100 * dup_line_chars <= rules.max_dup_line_chars_pct * total
        )
        return n, total, n_symbols, dup_lines, repeat_words, dup_line_chars, dup_chars, base_failed, kept

    return measure


def repetition_coverage(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()
) -> DataFrame:
    """One row per document: base counts, characters inside duplicated n-grams and lines, the verdict.

    Words are runs free of the six ASCII spaces. Window hashes of each length in ``rules`` mark the
    n-grams that occur twice or more in the same text; their characters, each counted once, are the
    coverage. No shuffle: every row is measured where it is read.

    Null or empty text: no words, base_failed, not kept. Very long texts are measured whole, in memory
    of some ten times their size. Repeated rows: a row each. Null ids stay null. Empty table: no rows.
    Other input columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA_TAIL.split(", ")]
    types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.bool_(), pa.bool_()]

    def make():
        measure = _measure(rules)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t) for t in raw_texts(batch.column(1))]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *names])

        return kernel

    return map_batches(df.select(id_col, text_col), make, f"{id_col} {id_type}, {SCHEMA_TAIL}")


def keep_good(df: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``df`` that the rules keep, columns unchanged; a filter on Arrow batches, no shuffle or join.

    Null and empty texts go. Very long ones are measured whole. Repeated rows stay or go alike. Empty
    table: no rows.
    """
    at = df.columns.index(text_col)

    def make():
        measure = _measure(rules)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([measure(t)[-1] for t in raw_texts(batch.column(at))], pa.bool_()))

        return kernel

    return map_batches(df, make, ddl(df))
