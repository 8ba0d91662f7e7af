"""Rolling hashes of bytes in numpy: 64-bit polynomials over random letters, then mixed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any ranges of a buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal bytes have equal hashes; the length is part of the hash."""
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(value + (end - start).astype(np.uint64))
