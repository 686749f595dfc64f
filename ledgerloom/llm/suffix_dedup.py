"""Suffix-array dedup: bytes covered by a long string that starts anywhere else too.

Prefix doubling on every byte position would shuffle many times the text. So ranks start at sampled
positions, chosen by content alone, and unique ones leave before the offset grows:

1. Every run of SAMPLE_RUN consecutive SEED-byte strings offers its smallest one by hash. Spark counts
   the offered strings. A window (``length`` bytes) is alive only while every offer inside it is
   repeated: where two windows are equal, so are their offers.
2. Windows that share their smallest seed form a piece, the string from the first of them to the
   end of the last. Spark ranks pieces by (seed, piece); a piece that occurs twice settles all its
   windows, a piece whose seed no other piece has is unique.
3. Alive windows of the pieces left are ranked as pairs (rank of the first half, rank at the offset
   of half a window), counted against each other and against settled pieces of the same seed.
   Pairs are named by 64 bits: n windows make about n * n / 2**65 chance equalities.

Ranks are hashes of the strings, so reranking is a count and nothing has to be sent back. Rounds 2
and 3 read the texts again and filter by bitmaps of fixed size; a bit set by chance adds rows, never
results. Bytes are judged on the input, copies inside one document included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Stage, lean, stage
from ledgerloom.llm.shingles import _TABLE, _powers, mix

LENGTH = 200
SEED = 32
SAMPLE_RUN = 64
#: Bytes of text handled at once; longer texts are cut into overlapping slices of that size.
BUFFER = 1 << 20
#: Bits of the maps sent to executors: 8 MB however many strings repeat.
FILTER_BITS = 1 << 26
BUCKET_BITS = 1 << 15
_PLACE = np.uint64((1 << 22) - 1)


@dataclass
class Buffer:
    """Some texts, or slices of them, side by side."""

    data: np.ndarray
    begin: np.ndarray  # of each unit in data
    end: np.ndarray
    row: np.ndarray  # index of the unit's document in the batch
    skip: np.ndarray  # where the unit begins in its document

    def __post_init__(self) -> None:
        forward, self.back = _powers(len(self.data))
        self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[self.data] * forward[:-1], out=self.sums[1:])
        self.unit_end = np.repeat(self.end, self.end - self.begin)

    def rank(self, at: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` bytes at each place."""
        with np.errstate(over="ignore"):
            length = np.asarray(length)
            return mix((self.sums[at + length] - self.sums[at]) * self.back[at] + length.astype(np.uint64))

    def starts(self, length: int) -> np.ndarray:
        """Places where that many bytes of one unit follow."""
        return np.flatnonzero(np.arange(len(self.data)) + length <= self.unit_end)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values; shorter runs at the end."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _seeds(buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the seed at each place, the same with its place in the low bits for minima)."""
    ranks = np.full(len(buffer.data), np.iinfo(np.uint64).max, dtype=np.uint64)
    at = buffer.starts(SEED)
    ranks[at] = buffer.rank(at, SEED)
    return ranks, (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)


def _offers(buffer: Buffer, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of whole runs, place of the seed each of them offers)."""
    at = buffer.starts(SEED + SAMPLE_RUN - 1)
    return at, (_lowest(packed, SAMPLE_RUN)[at] & _PLACE).astype(np.int64)


def buffers(batch: pa.RecordBatch, column: int, length: int) -> Iterator[Buffer]:
    units: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for row, text in enumerate(batch.column(column)):
        data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
        for at in range(0, max(1, len(data) - length + 1), BUFFER):
            unit = data[at:at + BUFFER + length - 1]
            if len(unit) < length:
                continue
            units.append((row, at, unit))
            size += len(unit)
            if size >= BUFFER:
                yield _join(units)
                units, size = [], 0
    if units:
        yield _join(units)


def _join(units: list[tuple[int, int, np.ndarray]]) -> Buffer:
    sizes = np.array([len(u[2]) for u in units])
    end = np.cumsum(sizes)
    return Buffer(
        np.concatenate([u[2] for u in units]), end - sizes, end,
        np.array([u[0] for u in units]), np.array([u[1] for u in units]),
    )


def _offered(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer in buffers(batch, 0, length):
                ranks, packed = _seeds(buffer)
                _, place = _offers(buffer, packed)
                found = ranks[np.unique(place)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["seed"])

    return run


@dataclass
class Pieces:
    """Runs of windows of a buffer with one smallest seed each, of which some window is alive."""

    row: np.ndarray
    first: np.ndarray  # in the buffer
    count: np.ndarray  # windows
    skip: np.ndarray  # from a place in the buffer to that in the document
    seed: np.ndarray
    rank: np.ndarray
    alive: np.ndarray  # by place in the buffer


def _pieces(buffer: Buffer, repeated: np.ndarray, length: int) -> Pieces | None:
    ranks, packed = _seeds(buffer)
    at, place = _offers(buffer, packed)
    lone = np.zeros(len(buffer.data) + 1, dtype=np.int64)
    lone[1 + at] = ~_bit(repeated, ranks[place].astype(np.int64))
    np.cumsum(lone, out=lone)
    windows = buffer.starts(length)
    inside = length - SEED - SAMPLE_RUN + 2  # runs within a window
    alive = np.zeros(len(buffer.data), dtype=bool)
    alive[windows] = lone[windows + inside] == lone[windows]
    if not alive.any():
        return None
    owner = (_lowest(packed, length - SEED + 1)[windows] & _PLACE).astype(np.int64)
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(windows)))
    used = np.add.reduceat(alive[windows].astype(np.int64), lead) > 0
    lead, count = lead[used], count[used]
    first = windows[lead]
    unit = np.searchsorted(buffer.end, first, side="right")
    return Pieces(
        buffer.row[unit], first, count, buffer.skip[unit] - buffer.begin[unit], ranks[owner[lead]].astype(np.int64),
        buffer.rank(first, count + length - 1).astype(np.int64), alive,
    )


def _bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.int64(FILTER_BITS - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _found_pieces(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for buffer in buffers(batch, 2, length):
                found = _pieces(buffer, repeated, length)
                if found is not None:
                    rows = pa.array(found.row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.first + found.skip),
                         pa.array(found.count), pa.array(found.seed), pa.array(found.rank)],
                        ["doc_id", "body", "first", "windows", "seed", "piece"],
                    )

    return run


def _found_windows(shared, length: int):
    """Alive windows: those of open pieces by document, those of settled pieces with an open one's seed by rank only."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, open_pieces, open_seeds = (np.frombuffer(m, dtype=np.uint8) for m in shared.value)
        for batch in batches:
            known: list[np.ndarray] = []
            for buffer in buffers(batch, 2, length):
                found = _pieces(buffer, repeated, length)
                if found is None:
                    continue

                def windows(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    """(piece, place, rank) of the alive windows of pieces; a rank names the pair of its halves' ranks."""
                    count = found.count[some]
                    at = np.repeat(found.first[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    piece = np.repeat(some, count)
                    lives = found.alive[at]
                    at, piece = at[lives], piece[lives]
                    with np.errstate(over="ignore"):
                        pair = buffer.rank(at, half) * np.uint64(0x9E3779B97F4A7C15) + buffer.rank(at + half, length - half)
                    return piece, at, mix(pair).astype(np.int64)

                is_open = _bit(open_pieces, found.seed ^ found.rank)
                settled = np.flatnonzero(~is_open & _bit(open_seeds, found.seed))
                # Of equal settled pieces in a buffer one is enough.
                settled = settled[np.unique(found.rank[settled], return_index=True)[1]]
                if len(settled):
                    known.append(np.unique(windows(settled)[2]))
                if is_open.any():
                    piece, at, rank = windows(np.flatnonzero(is_open))
                    rows = pa.array(found.row[piece])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at + found.skip[piece]), pa.array(rank),
                         pa.array(np.zeros(len(at), dtype=bool))],
                        ["doc_id", "body", "first", "rank", "known"],
                    )
            if known:
                rank = np.unique(np.concatenate(known))
                nothing = pa.nulls(len(rank), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [nothing, nothing, nothing, pa.array(rank), pa.array(np.ones(len(rank), dtype=bool))],
                    ["doc_id", "body", "first", "rank", "known"],
                )

    return run


def _map(keys: DataFrame, slot: Column) -> bytes:
    """One bit a key's slot, put together from at most FILTER_BITS / BUCKET_BITS rows of 4 KB."""
    pieces = (
        keys.select(slot.bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot"))
        .groupBy(F.shiftright("slot", 15).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(BUCKET_BITS - 1))).alias("bits"))
    )
    out = bytearray(FILTER_BITS // 8)
    for row in pieces.toLocalIterator():
        at = row["bucket"] * BUCKET_BITS // 8
        out[at:at + BUCKET_BITS // 8] = bytes(row["bits"])
    return bytes(out)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, spans, digests = [], [], [], []
        for text, first, last in zip(batch.column(1), batch.column(2), batch.column(3)):
            data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
            depth = np.zeros(len(data) + 1, dtype=np.int64)
            if first.is_valid:
                np.add.at(depth, first.values.to_numpy(), 1)
                np.add.at(depth, last.values.to_numpy(), -1)
            covered = np.cumsum(depth[:-1]) > 0
            sizes.append(len(data))
            gone.append(int(covered.sum()))
            spans.append(int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum()))
            digests.append(hashlib.sha256(data[~covered].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(digests, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, first, last): byte ranges of repeated strings; ``body`` is a hash of the text.

    Ranges of a document may overlap. Rows with the same id and text have the same ranges.
    """
    if length < SEED + SAMPLE_RUN:
        raise ValueError(f"length must be at least {SEED + SAMPLE_RUN}")
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    texts = texts.select("doc_id", F.xxhash64("raw").alias("body"), "raw")
    # A place that two slices offer counts twice: that keeps a window alive and settles nothing.
    seeds = texts.select("raw").mapInArrow(lean(_offered(length)), "seed long").groupBy("seed").count().filter("count > 1")
    repeated = _map(seeds, F.col("seed"))
    pieces = stage(
        texts.mapInArrow(
            lean(_found_pieces(context.broadcast(repeated), length)),
            "doc_id long, body long, first long, windows long, seed long, piece long",
        ),
        "pieces",
    )
    ranked = stage(pieces.groupBy("seed", "piece").agg(F.count("*").alias("c")), "piece-ranks")
    by_seed = ranked.groupBy("seed").agg(F.sum("c").alias("all"), F.min("c").alias("least"))
    open_seeds = stage(by_seed.filter("least = 1 and all > 1").select("seed"), "open-seeds")
    open_pieces = ranked.filter("c = 1").join(open_seeds, "seed", "left_semi")
    maps = (
        repeated, _map(open_pieces, F.col("seed").bitwiseXOR(F.col("piece"))), _map(open_seeds, F.col("seed")),
    )
    windows = Stage(
        texts.mapInArrow(
            lean(_found_windows(context.broadcast(maps), length)),
            "doc_id long, body long, first long, rank long, known boolean",
        ),
        "windows",
    )
    twice = F.sum(F.when(F.col("known"), 2).otherwise(1)) > 1
    again = stage(windows.df.groupBy("rank").agg(twice.alias("twice")).filter("twice").select("rank"), "repeated-windows")
    single = stage(
        windows.df.filter("not known").join(again, "rank", "left_semi")
        .select("doc_id", "body", "first", (F.col("first") + length).alias("last")), "window-spans",
    )
    windows.drop()
    settled = pieces.join(ranked.filter("c > 1").select("seed", "piece"), ["seed", "piece"], "left_semi")
    return settled.select(
        "doc_id", "body", "first", (F.col("first") + F.col("windows") + (length - 1)).alias("last")
    ).unionByName(single)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    Every byte of a string of ``length`` bytes that starts anywhere else too is removed, all
    occurrences. Null counts as empty; texts shorter than ``length`` lose nothing. Repeated rows are
    copies of each other. An empty table gives an empty result. Other columns are ignored.
    """
    spans = stage(
        repeated_spans(docs, length, id_col, text_col).groupBy("doc_id", "body").agg(
            F.collect_list(F.struct("first", "last")).alias("spans")
        ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "spans.first", "spans.last"), "spans",
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    texts = texts.withColumn("body", F.xxhash64("raw"))
    return (
        texts.join(spans, (F.col("body") == F.col("_body")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        .select("doc_id", "raw", "first", "last")
        .mapInArrow(lean(_removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
