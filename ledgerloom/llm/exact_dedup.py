"""Exact dedup by composable polynomial fingerprints.

A document's bytes are cut into chunks. Each chunk has a polynomial hash modulo two primes, and
hashes of neighbouring chunks combine by length-shifted arithmetic,
``H(xy) = H(x) * B**len(y) + H(y)``, so a huge document is hashed piece by piece. Documents with
equal (fingerprints, length) form a group. Groups of several rows are then compared chunk by
chunk: at each chunk place the smallest and largest chunk of the group must be the same bytes.
Minima and maxima are pre-aggregated in each task, so a group holding a third of all rows sends
one chunk a task and place. A group that fails is split by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
CHUNK = 1 << 16
#: Bits of the map of group fingerprints that the second scan filters by: 512 KB at any size.
FILTER_BITS = 1 << 22
BUCKET_BITS = 1 << 15

Fingerprint = tuple[int, int, int]


def _powers(n: int) -> np.ndarray:
    out = np.empty((len(PRIMES), n), dtype=np.int64)
    for k, (p, b) in enumerate(zip(PRIMES, BASES)):
        value = 1
        row = out[k]
        for i in range(n - 1, -1, -1):
            row[i] = value
            value = value * b % p
    return out


def hash_chunk(data: np.ndarray, powers: np.ndarray) -> tuple[int, ...]:
    """Polynomial hash of at most CHUNK bytes modulo each prime; sums stay below 2**63."""
    n = len(data)
    wide = data.astype(np.int64)
    return tuple(int(wide @ row[len(row) - n:]) % p for row, p in zip(powers, PRIMES))


def combine(left: Fingerprint, right: Fingerprint) -> Fingerprint:
    """Fingerprint of the concatenation of two byte strings from theirs (h1, h2, length)."""
    shifted = [(h * pow(b, right[2], p) + g) % p for h, g, p, b in zip(left, right, PRIMES, BASES)]
    return shifted[0], shifted[1], left[2] + right[2]


def fingerprint(data: np.ndarray, powers: np.ndarray, chunk: int = CHUNK) -> Fingerprint:
    out = (0, 0, 0)
    for at in range(0, len(data), chunk):
        part = data[at:at + chunk]
        out = combine(out, (*hash_chunk(part, powers), len(part)))
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)), offsets


def _prints(column: pa.Array, powers: np.ndarray) -> list[Fingerprint]:
    data, offsets = _texts(column)
    return [fingerprint(data[a:b], powers) for a, b in zip(offsets[:-1], offsets[1:])]


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers(CHUNK)
    for batch in batches:
        found = np.array(_prints(batch.column(1), powers), dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(found[:, k]) for k in range(3)), batch.column(2)],
            ["doc_id", "h1", "h2", "n", "text_sha256"],
        )


def _slot(h1: int, h2: int, n: int) -> int:
    return (h1 * 31 + h2 * 17 + n) % FILTER_BITS


def _candidate_chunks(bitmap: bytes):
    """Chunks of the documents whose fingerprint's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK)
        bits = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little")
        for batch in batches:
            data, offsets = _texts(batch.column(0))
            rows: list[tuple] = []
            size = 0
            for a, b in zip(offsets[:-1], offsets[1:]):
                h1, h2, n = fingerprint(data[a:b], powers)
                if not bits[_slot(h1, h2, n)]:
                    continue
                for k, at in enumerate(range(a, b, CHUNK)):
                    rows.append((h1, h2, n, k, data[at:min(b, at + CHUNK)].tobytes()))
                    size += len(rows[-1][-1])
                if size > 1 << 23:
                    yield _chunk_batch(rows)
                    rows, size = [], 0
            yield _chunk_batch(rows)

    return run


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["h1", "h2", "n", "place", "chunk"]
    )


def _bitmap(groups: DataFrame) -> bytes:
    """One bit for each group's slot; FILTER_BITS / 8 bytes however many groups there are."""
    slot = F.expr(f"(h1 * 31 + h2 * 17 + n) % {FILTER_BITS}")
    pieces = (
        groups.select(slot.alias("slot"))
        .groupBy(F.expr(f"slot div {BUCKET_BITS}").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.expr(f"slot % {BUCKET_BITS}")).alias("bits"))
    )
    out = bytearray(FILTER_BITS // 8)
    for row in pieces.collect():  # at most FILTER_BITS / BUCKET_BITS rows of 4 KB
        at = row["bucket"] * BUCKET_BITS // 8
        out[at:at + BUCKET_BITS // 8] = bytes(row["bits"])
    return bytes(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null text counts as empty. The row with the largest id of a group of identical texts stays; a
    null id is smaller than any other. Of rows repeated with the same id and text one is kept.
    Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    digests = stage(
        docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"), F.sha2(raw, 256).alias("text_sha256"))
        .mapInArrow(_with_fingerprint, "doc_id long, h1 long, h2 long, n long, text_sha256 string"),
        "fingerprints",
    )
    key = ["h1", "h2", "n"]
    groups = digests.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
    chunks = docs.select(raw.alias("raw")).mapInArrow(
        _candidate_chunks(_bitmap(groups)), "h1 long, h2 long, n long, place long, chunk binary"
    )
    broken = (
        chunks.groupBy(*key, "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .filter("low <> high").select(*key).distinct().withColumn("broken", F.lit(True))
    )
    keyed = digests.join(stage(broken, "collisions"), key, "left").withColumn(
        "split", F.when(F.col("broken"), F.col("text_sha256")).otherwise(F.lit(""))
    )
    # Repeated rows of one id are counted first and spread out again at the end.
    rows = stage(keyed.groupBy(*key, "split", "doc_id", "text_sha256").agg(F.count("*").alias("copies")), "rows")
    kept = rows.groupBy(*key, "split").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return (
        rows.join(kept, [*key, "split"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
