"""Elias-Fano sequences in numpy: monotone integers in about 2 + log2(universe / n) bits each, searched in batches."""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th (from 0) set bit of each 64-bit word, by halving."""
    place = np.zeros(len(words), dtype=np.uint64)
    left, rank = words.copy(), rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = left & ((_ONE << np.uint64(width)) - _ONE)
        ones = np.bitwise_count(low).astype(np.int64)
        above = rank >= ones
        rank = np.where(above, rank - ones, rank)
        place = np.where(above, place + np.uint64(width), place)
        left = np.where(above, left >> np.uint64(width), low)
    return place.astype(np.int64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with one count of zeros for each 64 bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        zeros = 64 - np.bitwise_count(high).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])
        self.ones = np.arange(len(high) + 1) * 64 - self.zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: sorted uint64 below the universe."""
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (values >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, dtype=np.int64)
        size = n + int((universe - 1) >> bits) + 2
        high = np.zeros(size // 64 + 1, dtype=np.uint64)
        at = top + np.arange(n)
        np.bitwise_or.at(high, at >> 6, _ONE << (at & 63).astype(np.uint64))
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        got = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        got[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return got & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def _first_with(self, top: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``top``: found at the top-th zero of the unary part."""
        out = np.zeros(len(top), dtype=np.int64)
        some = top > 0
        z = top[some] - 1
        word = np.searchsorted(self.zeros, z, side="right") - 1
        place = word * 64 + _select(~self.high[word], z - self.zeros[word])
        out[some] = place - z
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value not below x, n if there is none; x are below the universe."""
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        at, end = self._first_with(top), self._first_with(top + 1)
        want = x & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(x), dtype=np.uint64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            mid = (at[open_] + end[open_]) // 2
            less = self._low(mid) < want[open_]
            at[open_] = np.where(less, mid + 1, at[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[at[open_] < end[open_]]
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, dtype=np.int64)
        at = self.successor(x)
        here = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.get(here) == x), here, -1)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.low_bits], dtype=np.int64), f"{name}.low": self.low, f"{name}.high": self.high}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(x) for x in arrays[f"{name}.meta"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"])


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one behind the other, each from a multiple of 64 bytes on, behind a header with their places."""
    head, at, body = [], 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append([name, a.dtype.str, len(a), at])
        body.append(raw + bytes(-len(raw) % 64))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def load(raw: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a dumped file, as views of it; raw is a memory map or any array of bytes."""
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = 8 + size
    return {name: raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in json.loads(raw[8:base].tobytes())}
