"""Vectorised byte, word and shingle hashing over UTF-8 arrays (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value per byte; the polynomial base is odd, so it has an inverse modulo 2**64.
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The values of the bytes with A-Z lower-cased.
LOWER_VALUES = BYTE_VALUES[LOWER]

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, base: int, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Polynomial prefix sums of the bytes' values; n + 1 values."""
    out = np.zeros(len(data) + 1, np.uint64)
    part = np.take(values, data, mode="clip")
    part *= _powers(base, len(data) + 1)[0][: len(data)]
    np.cumsum(part, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the byte spans [start, end), the same wherever they stand."""
    return mix64((sums[ends] - sums[starts]) * _powers(base, len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes."""
    n = len(sums) - width
    return mix64((sums[width:] - sums[:-width]) * _powers(base, len(sums))[1][:n])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word, A-Z lower-cased."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return span_hashes(prefix_sums(LOWER[data] if lower else data, BASES[0]), starts, ends, BASES[0])


def batch_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that stand one after the other in ``data``, text i at [at[i], at[i + 1]).

    Returns the hashes (A-Z lower-cased, as ``word_hashes``) and each text's first place among them; n + 1 places.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = (data != 0x20) & (data - np.uint8(9) > 4)  # as _SEPARATOR; bytes below 9 wrap around
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return span_hashes(prefix_sums(data, BASES[0], LOWER_VALUES), starts, ends, BASES[0]), first


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle; no words, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mix64(total * np.uint64(0xD6E8FEB86659FD93) + words[i : n - width + 1 + i])
    return np.unique(total)
