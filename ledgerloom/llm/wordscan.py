"""Words of many texts at once, by one pass over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.shingles import mix

#: What a byte is: part of a word, a gap between words, or a break that no phrase crosses.
WORD, GAP, BREAK = 0, 1, 2
#: Bytes of text taken at once; a longer text is taken alone and whole.
SLICE = 6 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = (np.cumsum(size) - size) // SLICE
    cuts = np.flatnonzero(np.diff(turn)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def scan(texts: pa.Array, kind: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row of each word, run of each word): only A-Z are lower-cased; a break or a new text ends a run.

    ``kind`` says for each of the 256 bytes what it is. All separators are ASCII, so words are valid UTF-8.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ended = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    begins = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(ended.buffers()[2], dtype=np.uint8)[:int((size + 1).sum())]
    sort = kind[raw]
    sort[begins + size] = BREAK
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = sort == WORD
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = _LOWER[raw[inside[1:-1].view(bool)]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    per_row = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return words, np.repeat(np.arange(len(size)), per_row), np.searchsorted(np.flatnonzero(sort == BREAK), starts)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal ones, in any task."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    powers = np.full(max(int(size.max()), 1), _ODD, dtype=np.uint64)
    powers = np.cumprod(powers)
    out = np.zeros(len(words), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
        out[full] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], offsets[full])
    return mix(out + size.astype(np.uint64))


def then(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase continued by a word, from the hashes of both."""
    return mix(first * np.uint64(0xD1B54A32D192ED03) + word)
