"""Hashes of all spans of a byte array from one pass: polynomial prefixes modulo 2**64, then a mixing step."""

from __future__ import annotations

import numpy as np

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = have = (both[0], both[1])
    return have


class Spans:
    """``hash(starts, ends)`` of any spans of ``data``; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, base: int = 0x5851F42D4C957F2D):
        powers, self.inverse = _powers(base, len(data) + 1)
        self.acc = np.zeros(len(data) + 1, np.uint64)
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= powers[: len(data)]
        np.cumsum(values, out=self.acc[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.acc[ends] - self.acc[starts]) * self.inverse[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, width: int) -> np.ndarray:
        """The hashes of all spans of ``width`` bytes."""
        n = max(0, len(self.acc) - width)
        raw = self.acc[width:] - self.acc[:n]
        raw *= self.inverse[:n]
        raw += np.uint64(width * 0xD6E8FEB86659FD93 % 2**64)
        return mix64(raw)
