"""Vectorised 64-bit hashes of many short byte runs that lie in one buffer."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
#: A random 64-bit value for every byte.
BYTE_CODES = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: The same, with A-Z read as a-z.
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES
) -> np.ndarray:
    """A hash for each data[start:end], the same wherever the run lies."""
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = codes[data]
    terms *= _power_table(_BASE, len(data))
    np.cumsum(terms, out=sums[1:])
    h = sums[ends]
    h -= sums[starts]
    h *= _power_table(_INVERSE, len(data) + 1)[starts]
    return mix(h)
