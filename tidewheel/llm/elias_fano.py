"""Elias-Fano coding of a non-decreasing sequence, with a select directory.

Each value's low ``l`` bits stand in a packed array; its high part ``h`` sets bit ``h + i`` of a
bit vector for the i-th value.  With ``l = floor(log2(u / n))`` that is at most ``2 + log2(u / n)``
bits a value.  ``select`` finds the i-th set bit through a count kept every 512 bits.
"""
from __future__ import annotations

import struct

import numpy as np

BLOCK = 64  # bytes of the bit vector to one count of the directory
_HEAD = struct.Struct("<QQBxxxxxxx")


class EliasFano:
    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        counts = np.bitwise_count(high).astype(np.uint32)
        whole = np.concatenate([counts, np.zeros(-len(counts) % BLOCK, np.uint32)]).reshape(-1, BLOCK)
        self.before = np.concatenate([[0], np.cumsum(whole.sum(axis=1, dtype=np.int64))]).astype(np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the sequence must not decrease")
        universe = int(values[-1]) + 1 if universe is None and n else int(universe or 0)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) if bits else np.zeros((n, 0))
        high = np.zeros((((universe >> bits) + n + 8) // 8) * 8 if n else 0, np.uint8)
        if n:
            high[((values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
        return cls(n, universe, bits, np.packbits(low.astype(np.uint8).reshape(-1)), np.packbits(high))

    def select(self, i) -> np.ndarray:
        """Values at the positions ``i`` (an int or an array), by directory, block and bit."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("position outside the sequence")
        block = np.searchsorted(self.before, i, side="right") - 1
        out = np.zeros(len(i), np.int64)
        for b in np.unique(block):
            own = block == b
            bits = np.unpackbits(self.high[b * BLOCK : (b + 1) * BLOCK])
            out[own] = b * BLOCK * 8 + np.flatnonzero(bits)[i[own] - int(self.before[b])]
        high = (out - i).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(i)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.universe, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, universe, bits = _HEAD.unpack_from(raw)
        cut = _HEAD.size + (n * bits + 7) // 8
        return cls(n, universe, bits, np.frombuffer(raw[_HEAD.size : cut], np.uint8), np.frombuffer(raw[cut:], np.uint8))
