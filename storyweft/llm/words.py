"""Words of whole batches of texts as arrays: places, and 64-bit hashes by prefix sums."""

from __future__ import annotations

import numpy as np

#: A-Z in lower case, the white space \x20 and \x09-\x0D as U+0020, all else itself.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LOWERED[9:14] = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, np.uint64)


_KNOWN = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the odd step modulo 2^64, and of its inverse; kept for the next call."""
    if len(_KNOWN[0]) < n:
        for k, base in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            _KNOWN[k] = np.cumprod(powers, out=powers)
    return _KNOWN


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (shifts and odd multipliers)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice: a polynomial of its bytes' random values, mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of hashes, in their order."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_places(data: np.ndarray, offsets: np.ndarray, separator: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text; n + 1 values) of the words of each text."""
    inside = data != separator
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)
