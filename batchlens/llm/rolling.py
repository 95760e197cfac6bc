"""Array hashes of all substrings of one length, and sliding minima."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S, _T = np.uint64(32), np.uint64(29)
HIGH, POSITION = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one-to-one), in place."""
    values ^= values >> _S
    values *= _B
    values ^= values >> _T
    return values


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the concatenation (or of an overlapping cover) of two hashed strings."""
    out = left * _A
    out += right
    return mix(out)


def double(hashes: np.ndarray, times: int, size: int = 1) -> np.ndarray:
    """From hashes of all strings of ``size`` units to those of ``size * 2 ** times`` units."""
    for _ in range(times):
        hashes = join(hashes[:-size], hashes[size:]) if len(hashes) > size else hashes[:0]
        size *= 2
    return hashes


def cover(hashes: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Hashes of all strings of ``wanted`` units (size < wanted <= 2 size) from two overlapping halves."""
    gap = wanted - size
    return join(hashes[:-gap], hashes[gap:]) if len(hashes) > gap else hashes[:0]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width and len(values) > size:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    gap = width - size
    if gap:
        values = np.minimum(values[:-gap], values[gap:]) if len(values) > gap else values[:0]
    return values


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the position of its least one, the leftmost of equal ones."""
    ranked = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(ranked, width) & POSITION).astype(np.int64)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(change)
    return first, np.diff(first, append=n)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``size`` steps, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value occurs more than once, and whether it is one chosen occurrence of such a value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    flag, chosen = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    start = np.concatenate([[True], ~same]) if len(values) else np.zeros(0, dtype=bool)
    chosen[order[start]] = True
    return flag, chosen & flag
