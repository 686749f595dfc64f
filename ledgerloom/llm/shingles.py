"""Word shingles of a text as 64-bit hashes, computed from prefix sums over its bytes."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]))
        for k, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n + 1], _POWERS[1][:n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words in lower case.

    Words are separated by white space. A text of fewer words has one shingle, all its words; a
    text without words has none.
    """
    plain = " ".join((text or "").lower().split()).encode()
    if not plain:
        return np.empty(0, np.uint64)
    data = np.frombuffer(plain, dtype=np.uint8)
    forward, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * forward[:-1], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    if len(starts) > words:
        starts, ends = starts[:len(starts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)))


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set of shingles."""
    with np.errstate(over="ignore"):
        a = mix(found).sum(dtype=np.uint64)
        b = mix(found ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
