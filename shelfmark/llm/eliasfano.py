"""Elias-Fano coding of non-decreasing integers, with select in small sampled steps."""

from __future__ import annotations

import struct

import numpy as np

#: One position of the high bits is stored for this many values, in 32 bits.
SAMPLE = 64


class EliasFano:
    """n values up to u in about 2 + log2(u / n) bits each.

    The low bits of a value are stored as they are; the high bits are unary in one bit vector, where
    value i has its one at position high + i. ``select`` finds the i-th one from the nearest sample.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(bool), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (top >> low_bits) + 1, bool)
        bits[ones] = True
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Position of the i-th one."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, width = at // 8, 16
        first = int(self.high[byte]) & (0xFF << (at % 8)) & 0xFF
        while True:
            window = self.high[byte:byte + width].copy()
            window[0] = first
            counts = np.cumsum(np.bitwise_count(window))
            if counts[-1] > left:
                break
            width *= 2
        k = int(np.searchsorted(counts, left, side="right"))
        left -= int(counts[k - 1]) if k else 0
        ones = np.flatnonzero(np.unpackbits(window[k:k + 1], bitorder="little"))
        return (byte + k) * 8 + int(ones[left])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        piece = self.low[first // 8:(first + self.low_bits + 7) // 8].tobytes()
        low = (int.from_bytes(piece, "little") >> (first % 8)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        bits = np.unpackbits(self.high, bitorder="little")
        high = (np.flatnonzero(bits)[:self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, -1)
        return high | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QB3Q", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, *sizes = struct.unpack_from("<QB3Q", raw)
        at, parts = struct.calcsize("<QB3Q"), []
        for size, kind in zip(sizes, ("u1", "u1", "<u4")):
            parts.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, low_bits, *parts)
