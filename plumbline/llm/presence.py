"""A bitmap of which hashed keys occur: a filter of fixed size that spares shuffles.

False positives only let rows through that a later join drops; there are no false negatives. When there are
more keys than bits the filter passes everything and results stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64


@dataclass(frozen=True)
class Presence:
    bits: int
    words: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For int64 keys, whether each may occur."""
        slot = (mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.words[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _slots(batches, bits):
    import pyarrow as pa

    for rb in batches:
        keys = rb.column(0).drop_null().to_numpy()
        slot = np.unique(mix64(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])


def presence(keys: DataFrame, column: str, bits: int) -> Presence:
    """The bitmap of a long column. Only its 2 ** (bits - 3) bytes come to the driver."""
    slots = keys.select(F.col(column).cast("long")).mapInArrow(lambda it: _slots(it, bits), "slot long")
    # Spark's bitmap positions count from 1
    parts = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bytes"))
    words = np.zeros(1 << max(0, bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bytes"]), np.uint8)[: max(0, len(words) - at)]
        words[at : at + len(part)] = part
    return Presence(bits, words)


def sized_presence(keys: DataFrame, column: str, most_bits: int) -> Presence:
    """The bitmap of a written table's keys with 16 bits or more for each, up to 2 ** most_bits in all."""
    n = keys.count()
    return presence(keys, column, max(10, min(most_bits, (16 * n).bit_length())))
