"""Hashes over byte arrays, whole batches at a time. All values are 64-bit and wrap around; runs agree."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
BASE = np.uint64(int(_RNG.integers(0, 2**62)) * 4 + 5)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other (the splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 ... base**(n-1)"""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]
