"""Counting quotient filters without loss: n-grams of word ids packed, permuted invertibly and kept as quotient, whole remainder and count."""

from __future__ import annotations

import struct

import numpy as np

from marketlake.llm.shared import mix64

_HEAD = struct.Struct("<QBBHI")  # top bits that all entries share, how many these are, quotient bits, bits of a key, entries
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The multipliers of mix64, inverted.
_BACK = [np.uint64(pow(c, -1, 2**64)) for c in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * _BACK[0]
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * _BACK[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def key_bits(words: int, bits: int) -> int:
    """Bits of a packed key of so many ids: whole bytes, four at least."""
    return max(32, -(-words * bits // 8) * 8)


def pack(ids: list[np.ndarray], bits: int, size: int) -> list[np.ndarray]:
    """Ids side by side in limbs of 64 bits; a key of less than one limb stands in its top bits."""
    limbs = [np.zeros(len(ids[0]), np.uint64) for _ in range(-(-size // 64))]
    for i, x in enumerate(ids):
        at, shift = divmod(i * bits, 64)
        limbs[at] |= x.astype(np.uint64) << np.uint64(shift)
        if shift + bits > 64:
            limbs[at + 1] |= x.astype(np.uint64) >> np.uint64(64 - shift)
    return [limbs[0] << np.uint64(64 - size)] if size < 64 else limbs


def unpack(limbs: list[np.ndarray], bits: int, words: int, size: int) -> list[np.ndarray]:
    out, mask = [], np.uint64(2**bits - 1)
    limbs = [limbs[0] >> np.uint64(64 - size)] if size < 64 else limbs
    for i in range(words):
        at, shift = divmod(i * bits, 64)
        x = limbs[at] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | limbs[at + 1] << np.uint64(64 - shift)
        out.append(x & mask)
    return out


def _steps(size: int) -> list[tuple[int, int, int]]:
    """The steps of the permutation: each changes one limb by a hash of the others, so each can be undone."""
    return [(r, i, min(64, size - 64 * i)) for r in range(2) for i in range(-(-size // 64))]


def _others(limbs: list[np.ndarray], i: int, r: int) -> np.ndarray:
    x = np.full(len(limbs[0]), r + 1, np.uint64)
    for j, y in enumerate(limbs):
        if j != i:
            x = mix64(x * _ODD + y)
    return x


def _halves(x: np.ndarray, size: int, rounds: range) -> np.ndarray:
    """Feistel rounds on the two halves of a key of less than 64 bits; in reverse order they undo themselves."""
    low = size // 2
    top, bottom = x >> np.uint64(64 - size + low), x >> np.uint64(64 - size) & np.uint64(2**low - 1)
    for r in rounds:
        if r % 2:
            bottom = bottom ^ (mix64((top + np.uint64(r)) * _ODD) >> np.uint64(64 - low))
        else:
            top = top ^ (mix64((bottom + np.uint64(r)) * _ODD) >> np.uint64(64 - (size - low)))
    return (top << np.uint64(low) | bottom) << np.uint64(64 - size)


def permute(limbs: list[np.ndarray], size: int) -> list[np.ndarray]:
    """A bijection on keys of ``size`` bits that spreads them evenly."""
    if size < 64:
        return [_halves(limbs[0], size, range(6))]
    limbs = list(limbs)
    for r, i, width in _steps(size):
        x = limbs[i] ^ (_others(limbs, i, r) >> np.uint64(64 - width))
        limbs[i] = mix64(x) if width == 64 else x
    return limbs


def restore(limbs: list[np.ndarray], size: int) -> list[np.ndarray]:
    if size < 64:
        return [_halves(limbs[0], size, range(5, -1, -1))]
    limbs = list(limbs)
    for r, i, width in reversed(_steps(size)):
        x = unmix64(limbs[i]) if width == 64 else limbs[i]
        limbs[i] = x ^ (_others(limbs, i, r) >> np.uint64(64 - width))
    return limbs


def combine(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys in order, equal ones once with the sum of their counts."""
    order = np.argsort(limbs[0], kind="stable")
    rows = [x[order] for x in limbs]
    if len(limbs) > 1:
        tied = rows[0][1:] == rows[0][:-1]
        if (tied & np.logical_or.reduce([x[1:] != x[:-1] for x in rows[1:]])).any():  # different keys under one first limb
            order = np.lexsort(limbs[::-1])
            rows = [x[order] for x in limbs]
    if not len(order):
        return rows, counts
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in rows])])
    at = np.flatnonzero(new)
    return [x[at] for x in rows], np.add.reduceat(counts[order], at)


def encode(limbs: list[np.ndarray], counts: np.ndarray, size: int, shared: int = 0) -> bytes:
    """Sorted entries, of whose first limb ``shared`` top bits are alike (a multiple of 8), as one filter.

    The next bits are the quotient, about as many as number the entries: its runs stand in unary, a one for each entry and a zero for each
    quotient. All further bits are the remainder, stored whole, so nothing is lost. A bit tells counts above one, which follow.
    """
    n = len(counts)
    q = min(min(size, 64) - shared, 24, max(0, (n.bit_length() - 1) // 8 * 8))
    top = int(limbs[0][0] >> np.uint64(64 - shared)) if shared and n else 0
    quotient = (limbs[0] << np.uint64(shared) >> np.uint64(64 - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    runs = np.zeros(n + (1 << q), np.uint8)
    runs[np.arange(n) + quotient] = 1
    rest = [x.astype(">u8").view(np.uint8).reshape(n, 8) for x in limbs]
    parts = [rest[0][:, (shared + q) // 8 : min(size, 64) // 8]] + [x[:, 8 - min(8, (size - 64 * i) // 8) :] for i, x in enumerate(rest[1:], 1)]
    many = counts > 1
    big = counts[many]
    small = np.minimum(big, 255).astype(np.uint8)
    return b"".join([
        _HEAD.pack(top, shared, q, size, n), np.packbits(runs).tobytes(), np.concatenate(parts, axis=1).tobytes() if n else b"", np.packbits(many).tobytes(), small.tobytes(), big[small == 255].astype("<u8").tobytes(),
    ])


def decode(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    top, shared, q, size, n = _HEAD.unpack_from(blob)
    raw, at = np.frombuffer(blob, np.uint8), _HEAD.size

    def take(k: int) -> np.ndarray:
        nonlocal at
        at += k
        return raw[at - k : at]

    runs = np.unpackbits(take(-(-(n + (1 << q)) // 8)), count=n + (1 << q))
    quotient = np.flatnonzero(runs) - np.arange(n)
    places = [((shared + q) // 8, min(size, 64) // 8)] + [(8 - min(8, (size - 64 * i) // 8), 8) for i in range(1, -(-size // 64))]
    width = sum(b - a for a, b in places)
    rest, limbs, begin = take(n * width).reshape(n, width), [], 0
    for a, b in places:
        full = np.zeros((n, 8), np.uint8)
        full[:, a:b] = rest[:, begin : begin + b - a]
        limbs.append(full.reshape(-1).view(">u8").astype(np.uint64))
        begin += b - a
    if q:
        limbs[0] |= quotient.astype(np.uint64) << np.uint64(64 - shared - q)
    if shared:
        limbs[0] |= np.uint64(top) << np.uint64(64 - shared)
    many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    big = take(int(many.sum())).astype(np.int64)
    large = big == 255
    big[large] = np.frombuffer(take(8 * int(large.sum())).tobytes(), "<u8").astype(np.int64)
    counts[many] = big
    return limbs, counts


def merge(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of several filters, in order, counts of equal keys added."""
    read = [decode(b) for b in blobs]
    return combine([np.concatenate(x) for x in zip(*[limbs for limbs, _ in read], strict=True)], np.concatenate([c for _, c in read]))


def split(limbs: list[np.ndarray], counts: np.ndarray, size: int, shared: int, step: int) -> list[tuple[int, bytes]]:
    """(range, filter) for each range of the next ``step`` top bits that has entries."""
    if not len(counts):
        return []
    parts = limbs[0] >> np.uint64(64 - shared - step)
    begins = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    whole = (shared + step) // 8 * 8  # filters share whole bytes
    return [(int(parts[i]), encode([x[i:j] for x in limbs], counts[i:j], size, whole)) for i, j in zip(begins, [*begins[1:], len(parts)], strict=True)]
