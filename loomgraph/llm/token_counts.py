"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_words import WordVocabulary
from .common import BoundedCache, held, map_batches, raw_texts


def _counter(vocabulary: str):
    """The vocabulary and its cache of counts."""
    words = WordVocabulary(vocabulary)
    return words, BoundedCache(words.count).__getitem__


def count_tokens(
    df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A text is cut into pieces by the vocabulary's rules; each piece's count comes from the merge
    loop of ``WordVocabulary.count``, kept in a bounded cache per worker. Special strings inside a
    text count one token each, as the library's default has it. No identifiers are made, no shuffle.

    Null text: as empty, 0 bytes and 0 tokens. Very long texts are counted whole. Repeated rows: a row each. Null ids stay null. Empty
    table: no rows. Other input columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        words, get = held(("token_counts", vocabulary), lambda: _counter(vocabulary))

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, counts = [], []
            for raw in raw_texts(batch.column(1)):
                raw = raw or b""
                sizes.append(len(raw))
                counts.append(sum(1 if p is None else sum(map(get, p)) for _, p in words.parts(raw.decode())))
            over = [n > limit for n in counts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

        return kernel

    schema = f"{id_col} {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    return map_batches(df.select(id_col, text_col), make, schema)
