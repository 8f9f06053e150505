"""Word shingles of whole texts as 64-bit hashes, by array operations on the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_BLOCK, _BASE))
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _STEPS[0]
    x = (x ^ (x >> _U(27))) * _STEPS[1]
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, A-Z lower-cased."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    packed = raw[inside[1:-1]].astype(_U) + _U(1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    offset = np.arange(len(packed)) - np.repeat(first, lengths)
    packed *= _POWERS[offset % _BLOCK]
    if lengths.max() > _BLOCK:
        packed *= mix((offset // _BLOCK).astype(_U)) | _U(1)
    return mix(np.add.reduceat(packed, first) + lengths.astype(_U))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; of a shorter text its whole sequence; of none nothing."""
    h = word_hashes(text) if text else np.zeros(0, _U)
    n = len(h)
    if not n:
        return h
    take = min(width, n)
    s = np.zeros(n - take + 1, _U)
    for k in range(take):
        s += mix(h[k : n - take + 1 + k] + _U(k + 1)) * _STEPS[k % len(_STEPS)]
    return np.unique(mix(s + _U(take)))
