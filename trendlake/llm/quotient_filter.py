"""Counting quotient filters over packed keys: exact, compact, sorted.

A key of ``bits`` bits is permuted by an invertible map. The high bits of the
result are the quotient, which is stored as a place (one bit says whether a
quotient occurs, one bit ends its run), all other bits are the remainder, which
is stored in full. So a filter gives its keys and counts back without loss, and
as entries stand in the order of their permuted keys, filters are merged like
sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_HEAD = "<QBB"


def permuted(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers below ``2 ** bits``."""
    mask, half, odd = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2), np.uint64(_ODD & ((1 << bits) - 1) | 1)
    x = keys.astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> half)) * odd & mask
    return x ^ (x >> half)


def restored(values: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``permuted``."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    inverse = np.uint64(pow(_ODD & ((1 << bits) - 1) | 1, -1, 1 << bits))
    x = values ^ (values >> half)
    for _ in range(2):
        x = x * inverse & mask
        x = x ^ (x >> half)
    return x


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their counts added up. Sorted stretches are merged, not sorted again."""
    if not len(values):
        return values.astype(np.uint64), np.zeros(0, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if counts is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(counts[order], first)


def packed(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of ascending permuted keys below ``2 ** bits``."""
    n = len(values)
    q = min(bits, max(1, (n - 1).bit_length()))
    rest = bits - q
    quotients = (values >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, dtype=bool)
    remainders = (values & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : (rest + 7) // 8]
    several = counts > 1
    more = counts[several]
    width = next(w for w in (1, 2, 4, 8) if not len(more) or more.max() < 1 << (8 * w - 1))
    return b"".join((
        struct.pack(_HEAD, n, q, width), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        np.ascontiguousarray(remainders).tobytes(), np.packbits(several).tobytes(), more.astype(f"<i{width}").tobytes(),
    ))


def unpacked(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending permuted keys of a filter, and their counts."""
    n, q, width = struct.unpack_from(_HEAD, data)
    at, rest = struct.calcsize(_HEAD), bits - q

    def flags(size: int) -> np.ndarray:
        nonlocal at
        raw = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
        at += len(raw)
        return np.unpackbits(raw, count=size).astype(bool)

    occupied, ends = np.flatnonzero(flags(1 << q)), flags(n)
    size = (rest + 7) // 8
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    run = np.cumsum(ends) - ends  # how many runs end before an entry
    values = low.view("<u8").ravel().astype(np.uint64)
    if n:
        values |= occupied[run].astype(np.uint64) << np.uint64(rest)
    several = flags(n)
    counts = np.ones(n, dtype=np.int64)
    counts[several] = np.frombuffer(data, f"<i{width}", int(several.sum()), at)
    return values, counts


def sliced(keys: np.ndarray, bits: int, cuts: int) -> list[tuple[int, bytes]]:
    """Filters of raw keys, one for each of the ``2 ** cuts`` ranges of permuted keys that occurs."""
    values, counts = counted(permuted(keys, bits))
    low = bits - cuts
    part = (values >> np.uint64(low)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=int)
    inside = values & np.uint64((1 << low) - 1)
    return [
        (int(part[a]), packed(inside[a:b], counts[a:b], low)) for a, b in zip(edges, np.append(edges[1:], len(part)))
    ]
