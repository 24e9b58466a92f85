"""A filter of bits over 64-bit keys, built on executors.

It tells which rows may be wanted, so that only those are moved. A wrong yes is
dropped by the join that follows; there is no wrong no. The filter has 16 bits
for each key, up to MOST_BITS; with more keys than that it lets more pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.blocks import BLOCK_CELLS, gathered, has_bits, set_bits
from quern.llm.bytetext import mix

#: 32 MB at most, which is what a broadcast filter may have.
LEAST_BITS, MOST_BITS = BLOCK_CELLS << 3, 1 << 28


def key_filter(keys: DataFrame, count: int) -> Callable[[np.ndarray], np.ndarray]:
    """keys is one bigint column of about `count` rows; the result maps an array of keys to booleans and travels with tasks as a broadcast."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(count, 1) - 1).bit_length()))

    def spot(wanted: np.ndarray) -> np.ndarray:
        return (mix(wanted.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    def fill(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        set_bits(cells, spot(batch.column(0).to_numpy(zero_copy_only=False)))

    shared = keys.sparkSession.sparkContext.broadcast(gathered(keys, fill, bits >> 3, "uint8", bits=True))
    return lambda wanted: has_bits(shared.value, spot(wanted))
