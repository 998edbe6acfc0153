"""Elias-Fano code of a non-decreasing integer sequence, with select.

Each value is split at bit `low`. The low parts lie in a packed bit array; the high part h of value
number i sets bit h + i of a second bit array. Every 64th set bit's place is stored, so select walks
at most a few bytes from a known place. About 2 + log2(universe / n) bits for each value.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")
_STEP = 64


class EliasFano:
    def __init__(self, n: int, universe: int, low: int, lows: np.ndarray, highs: np.ndarray, marks: np.ndarray):
        self.n, self.universe, self.low, self.lows, self.highs, self.marks = n, universe, low, lows, highs, marks

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must be non-negative and must not decrease")
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low)) & 1
        places = (v >> low) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        return cls(n, universe, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::_STEP].astype("<u4"))

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.marks[i // _STEP]), i % _STEP
        while left:
            place += 1
            left -= (self.highs[place >> 3] >> (place & 7)) & 1
        value, at = place - i, i * self.low
        lows = 0
        for k in range(self.low):
            lows |= int((self.lows[(at + k) >> 3] >> ((at + k) & 7)) & 1) << k
        return (value << self.low) | lows

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        lows = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return ((places - np.arange(self.n)) << self.low) | (lows.astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.universe, self.low) + self.lows.tobytes() + self.highs.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low = _HEAD.unpack_from(data)
        a, marks = _HEAD.size + (n * low + 7) // 8, 4 * ((n + _STEP - 1) // _STEP)
        end = len(data) - marks
        cut = lambda i, j, kind: np.frombuffer(data, kind, (j - i) // np.dtype(kind).itemsize, i)
        return cls(n, universe, low, cut(_HEAD.size, a, "u1"), cut(a, end, "u1"), cut(end, len(data), "<u4"))
