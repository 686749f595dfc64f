"""A bit map of ids of fixed size, to filter rows by before a join.

A set bit may be chance, so a filtered row is only a candidate; a row that is wanted always passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean
from ledgerloom.llm.shingles import mix

#: 512 KB however many ids there are.
FILTER_BITS = 1 << 22
BUCKET_BITS = 1 << 15


def slots_of(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.unique(slots_of(batch.column(0).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array(slots // BUCKET_BITS), pa.array(slots % BUCKET_BITS)], ["bucket", "bit"])


def id_map(ids: DataFrame) -> np.ndarray:
    """Whether each slot is used by the ids of a one-column table without null."""
    pieces = ids.mapInArrow(_slots, "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in pieces.collect():  # at most FILTER_BITS / BUCKET_BITS rows of 4 KB
        at = row["bucket"] * BUCKET_BITS // 8
        out[at:at + BUCKET_BITS // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = slots_of(ids)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def candidates(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows whose first column, a long without null, may be one of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(bits, batch.column(0).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(lean(run), rows.schema)
