"""A bitmap of fixed size over the ids of a table: tasks drop most rows that a join would drop, before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import mix64

#: 4 MB, whatever the number of ids; with very many ids it lets every row through and the join does the work
BITS = 1 << 25


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


class Bitmap:
    """``may_hold`` is never false for an id of the table."""

    def __init__(self, shared):
        self.shared = shared

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        slots = _slots(ids)
        return (self.shared.value[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) != 0


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = _slots(batch.column(0).to_numpy(zero_copy_only=False))
        bits = (np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(bits)], ["word", "bits"])


def bitmap_of(ids: DataFrame) -> Bitmap:
    """The bitmap of the one bigint column of ``ids`` (no nulls). At most ``BITS / 64`` words reach the driver."""
    rows = ids.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BITS // 64, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return Bitmap(ids.sparkSession.sparkContext.broadcast(words))
