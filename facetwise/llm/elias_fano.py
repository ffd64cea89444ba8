"""Elias-Fano lists: n non-decreasing numbers below u in about n * (2 + log2(u / n)) bits, with select in place.

The low l = floor(log2(u / n)) bits of each number stand packed in one array; its other bits, h, set bit h + i of a
bit vector for the i-th number. Each SAMPLE-th set bit's place is kept, so that number i is found from the sample
before it by counting bits, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<QQB")  # n, words of high bits in bytes, l


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def build(values: np.ndarray) -> bytes:
    """values: unsigned 64-bit, non-decreasing."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    top = int(values[-1]) + 1
    low = max(0, (top // n).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    vector = np.zeros(int(high[-1]) + 1, np.uint8)
    vector[high] = 1
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    packed = _pack(vector)
    return _HEAD.pack(n, len(packed), low) + high[::SAMPLE].astype("<u4" if len(vector) < 2**32 else "<u8").tobytes() + packed + _pack(lows)


class EliasFano:
    def __init__(self, data: bytes | memoryview):
        data = memoryview(data).cast("B")
        self.n, length, self.low = _HEAD.unpack_from(data)
        at = _HEAD.size
        kind = np.dtype("<u4" if 8 * length < 2**32 else "<u8")
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, kind, samples, at)
        at += samples * kind.itemsize
        self.high = data[at : at + length]
        at += length
        self.size = at + -(-self.n * self.low // 8)
        self.lows = data[at : self.size]

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits still to pass
        byte = place // 8
        word = self.high[byte] >> (place % 8)
        base = place
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            base = 8 * byte
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = base + ((word & -word).bit_length() - 1) - i
        bit = i * self.low
        lows = int.from_bytes(self.lows[bit >> 3 : (bit + self.low + 7) >> 3], "little") >> (bit & 7)
        return high << self.low | lows & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """Every number, unsigned 64-bit."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little", count=self.n * self.low).reshape(self.n, self.low).astype(np.uint64)
        low = (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if self.low else np.zeros(self.n, np.uint64)
        return high.astype(np.uint64) << np.uint64(self.low) | low
