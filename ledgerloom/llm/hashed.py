"""Hashed n-gram slots of a batch of texts, and dense slot counts summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots in one row of a table of dense counts.
WIDE = 64
#: Bytes of text handled at once.
SLICE = 1 << 18

#: ASCII bytes: letters in lower case, anything else a blank; bytes of other scripts as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def text_bytes(text: str | None) -> np.ndarray:
    """Folded UTF-8 bytes, with a blank at both ends and runs of blanks as one."""
    raw = FOLD[np.frombuffer(f" {(text or '').lower()} ".encode(), dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def gram_slots(data: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Slots below 2**bits of the byte n-grams of the given orders that start in the first SLICE bytes."""
    wide = data.astype(np.uint64)
    out = []
    for n in orders:
        if len(wide) < n:
            continue
        m = min(SLICE, len(wide) - n + 1)
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + wide[k:k + m] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def slices(data: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """Pieces of SLICE bytes and an overlap: each n-gram of up to overlap + 1 bytes starts in one piece only."""
    if len(data) <= SLICE:
        yield data
        return
    for at in range(0, len(data), SLICE):
        yield data[at:at + SLICE + overlap]


def dense_rows(label: str, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (label, range, c0..c63) of a vector of counts; ranges without a count are left out."""
    table = counts.reshape(-1, WIDE)
    used = np.flatnonzero(table.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array([label] * len(used), pa.string()), pa.array(used, pa.int64()),
         *(pa.array(np.ascontiguousarray(table[used, k]), pa.int64()) for k in range(WIDE))],
        ["label", "range", *(f"c{k}" for k in range(WIDE))],
    )


DENSE_SCHEMA = "label string, range long, " + ", ".join(f"c{k} long" for k in range(WIDE))


def dense_totals(parts: DataFrame, slots: int) -> dict[str, np.ndarray]:
    """Sums of dense rows by label; as many numbers as labels times slots, whatever the input."""
    summed = parts.groupBy("label", "range").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(WIDE)])
    out: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        out.setdefault(row[0], np.zeros(slots, dtype=np.int64)).reshape(-1, WIDE)[row[1]] = row[2:]
    return out
