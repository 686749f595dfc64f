"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The text is split by a pattern; each pre-token is merged on its own. Its symbols form a linked
list. A queue holds, for each merge rank, a bucket of list positions whose pair has that rank, and
a two-level bitmap marks the buckets in use: find-first-set on the upper level picks a word, on the
word the lowest rank. Popping a bucket gives its leftmost position; an entry whose pair has changed
since is stale and skipped, and the queue is left once no pair that can be merged is left. Each merge
costs the same however long the pre-token is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean

#: A word of the lower bitmap level has a bit for each of 2**SHIFT ranks.
SHIFT = 8
_LOW, _BIT = (1 << SHIFT) - 1, [1 << i for i in range(1 << SHIFT)]
_BYTES = [bytes([b]) for b in range(256)]
#: Distinct pre-tokens of one generation of a worker's memory. It keeps two: a full one grows old, and what is not
#: met again while the next one fills is forgotten, which costs time only.
MEMO = 300_000
#: Above so many characters pre-tokens are taken from the text piece by piece.
PIECE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        part: list[bytes | None] = [_BYTES[b] for b in piece]
        # Rank of the pair that begins at each position, and how many pairs have one.
        current = [rank_of(piece[i:i + 2]) for i in range(n - 1)]
        live = len(current) - current.count(None)
        current.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The queue: positions by rank, bits of ranks in use by word, bits of words in use. Written out where it is
        # used, as calls would cost more than the work.
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i, rank in enumerate(current):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(i)
                continue
            buckets[rank] = [i]
            word = rank >> SHIFT
            words[word] = words.get(word, 0) | _BIT[rank & _LOW]
            top |= 1 << word
        while live:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = (word << SHIFT) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits ^ low
                if not bits:
                    top &= top - 1
            if current[i] != rank:
                continue
            j = after[i]
            merged = part[i] + part[j]
            part[i], part[j] = merged, None
            live -= 1 + (current[j] is not None)
            current[j] = None
            k = after[i] = after[j]
            changed = [i] if k < n else []
            current[i] = None
            if k < n:
                before[k] = i
                current[i] = rank_of(merged + part[k])
            h = before[i]
            if h >= 0:
                live -= current[h] is not None
                current[h] = rank_of(part[h] + merged)
                changed.append(h)
            for at in changed:
                new = current[at]
                if new is None:
                    continue
                live += 1
                if new in buckets:
                    heappush(buckets[new], at)
                    continue
                buckets[new] = [at]
                word = new >> SHIFT
                words[word] = words.get(word, 0) | _BIT[new & _LOW]
                top |= 1 << word
        return [self.ranks[p] for p in part if p is not None]

    def _pack(self, words: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        try:
            return b"".join(map(self.packed.__getitem__, words))
        except KeyError:
            if len(self.packed) > MEMO:
                self.packed, self.older = {}, self.packed
            packed, older = self.packed, self.older
            for word in words:
                if word not in packed:
                    packed[word] = older.get(word) or b"".join([i.to_bytes(4, "little") for i in self.merge(word.encode())])
            return b"".join(map(packed.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if len(text) <= PIECE:
            return self._pack(self.pattern.findall(text))
        words = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: self._pack(list(islice(words, PIECE // 8))), b""))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                ids = [own.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                data = [own.decode(np.frombuffer(t.as_py(), dtype="<u4").tolist()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    return run


def _round_trip(path: str, pattern: str):
    """Encoding and decoding in one worker, piece by piece."""
    encode, decode = _encoder(path, pattern), _decoder(path, pattern)
    return lambda batches: decode(encode(batches))


def _slices(batch: pa.RecordBatch, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch of about so many bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, packed as little-endian 32-bit integers.

    Null and empty texts have no ids. One row per input row, repeated rows included; other columns
    are ignored. The vocabulary file must be at the same place on every executor.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lean(_encoder(path, pattern)), "doc_id long, ids binary"
    )


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that packed ids stand for; an id out of the table is an error."""
    return encoded.select("doc_id", "ids").mapInArrow(lean(_decoder(path, pattern)), "doc_id long, ids binary, decoded binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode of bpe_encode, in one pass of one worker a task."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lean(_round_trip(path, pattern)), "doc_id long, ids binary, decoded binary"
    )


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
