"""Fixed-size arrays summed over a whole corpus.

Each task sends its array in BLOCK_CELLS-cell blocks; blocks are combined in two
steps, so no task meets all tasks' blocks, and the result has a size that does
not depend on the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lean

BLOCK_CELLS = 1 << 14


def set_bits(cells: np.ndarray, spots: np.ndarray) -> None:
    """Sets bits of packed cells, the lowest of a cell first."""
    spots = np.unique(spots)
    first = np.flatnonzero(np.diff(spots >> 3, prepend=-1))
    if len(spots):
        cells[spots[first] >> 3] |= np.bitwise_or.reduceat(np.uint8(1) << (spots & 7).astype(np.uint8), first)


def has_bits(cells: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (cells[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)


def block_rows(cells: np.ndarray) -> pa.RecordBatch:
    """Non-empty blocks of a task's array."""
    found = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(cells.reshape(-1, BLOCK_CELLS)) if part.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["block", "cells"])


def _cells(data: bytes) -> np.ndarray:
    """A block's cells; those of eight bytes have a sign."""
    raw = zlib.decompress(data)
    width = len(raw) // BLOCK_CELLS
    return np.frombuffer(raw, f"<{'i' if width == 8 else 'u'}{width}")


def gathered(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, dtype: str, sums: str | None = None, bits: bool = False) -> np.ndarray:
    """fill(array, batch) over all batches in arrays of `dtype`, summed over tasks up to the largest value of `sums`, or with their bits united."""
    sums = sums or dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        cells, any_rows = np.zeros(size, dtype), False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                fill(cells, batch)
        if any_rows:
            yield block_rows(cells)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK_CELLS, np.int64)
        for x in group["cells"]:
            (np.bitwise_or if bits else np.add)(total, _cells(x), out=total, casting="unsafe")
        return pd.DataFrame({"block": [group["block"].iloc[0]], "cells": [zlib.compress(np.minimum(total, np.iinfo(sums).max).astype(sums).tobytes(), 1)]})

    schema = "block int, cells binary"
    rows = df.mapInArrow(run, schema).withColumn("part", F.spark_partition_id() % 64)
    once = rows.groupBy("block", "part").applyInPandas(lambda g: add(g), schema)
    out = np.zeros(size, sums)
    for row in once.groupBy("block").applyInPandas(add, schema).collect():
        out[row.block * BLOCK_CELLS : (row.block + 1) * BLOCK_CELLS] = _cells(row.cells)
    return out
