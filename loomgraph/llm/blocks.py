"""Blocks: batches of texts that look up corpus-wide figures of what they hold once for the block, not once for each place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import BATCH_BYTES, bounded_batches, own_kernel

BlockKernel = Callable[[pa.RecordBatch, int], Iterator[pa.RecordBatch]]


def cut(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose column ``text`` holds ``most`` bytes, or of one row."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    was = 0
    while was < batch.num_rows:
        end = max(was + 1, int(np.searchsorted(ends, (ends[was - 1] if was else 0) + most, "right")))
        yield batch.slice(was, end - was)
        was = end


def map_blocks(df: DataFrame, make_kernel: Callable[[], BlockKernel], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over batches whose second column, the text, is bounded by bytes, each numbered by its task and its place there.

    Write the result before it is used twice: the numbers name the batches of one run.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, task = own_kernel(make_kernel), TaskContext.get().partitionId()
        for k, block in enumerate(part for batch in batches for part in cut(batch, 1, most)):
            yield from kernel(block, task << 32 | k)

    return df.mapInArrow(run, schema)


def rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows with the columns given, all others null."""
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, f.type) if f.name not in columns else x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type)
            for f in schema
        ],
        schema=schema,
    )


class Numbered(dict):
    """Numbers keys in the order they come; ``keys_in_order`` lists them."""

    def __init__(self):
        super().__init__()
        self.keys_in_order: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self.keys_in_order)
        self.keys_in_order.append(key)
        return n


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32: their lower halves, then their upper ones, which are alike and so compress well."""
    wide = numbers.astype(np.uint32)
    return (wide & 0xFFFF).astype("<u2").tobytes() + (wide >> 16).astype("<u2").tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(raw, "<u2").reshape(2, -1).astype(np.uint32)
    return high << 16 | low


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all entries of runs that begin at ``starts`` and hold ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of ``values``, empty ones too."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
