"""Normalisation by a compiled character map that remembers where every byte came from.

A compiled map is a double-array trie of source strings followed by their
replacements, each ended by a zero byte.  At every character the longest source
string that the text goes on with is replaced; other characters stay.  All
characters of many joined texts walk down the trie together.  The result uses
one byte, a space, for a vocabulary's space sign, and holds for each of its
bytes the place of the source character or string it was made from.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Normalised(NamedTuple):
    """Joined normalised texts: bytes, the source byte each was made from, and per text where it ends and which source byte follows it."""

    raw: np.ndarray
    origin: np.ndarray
    ends: np.ndarray
    stop: np.ndarray


class CharMap:
    def __init__(self, compiled: bytes, prefix: bool, squeeze: bool):
        """``prefix``: texts start with a space sign; ``squeeze``: spaces at the borders go and runs of them become one."""
        self.prefix, self.squeeze = prefix, squeeze
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).astype(np.int64) if compiled else None
        self.made = np.frombuffer(compiled[4 + size:], dtype=np.uint8)
        zero = np.flatnonzero(self.made == 0)
        #: Length of the replacement that starts at each byte.
        self.made_size = zero[np.searchsorted(zero, np.arange(len(self.made)))] - np.arange(len(self.made)) if len(zero) else np.zeros(0, dtype=np.int64)

    def longest(self, raw: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and replacement of the longest source string at each place, 0 and -1 where there is none."""
        size, value = np.zeros(len(at), dtype=np.int64), np.full(len(at), -1, dtype=np.int64)
        if self.units is None or not len(self.units):
            return size, value
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        alive, depth = np.arange(len(at)), 0
        node = np.full(len(at), offset(self.units[0]), dtype=np.int64)
        while True:
            on = at[alive] + depth < limit[alive]
            alive, node = alive[on], node[on]
            if not len(alive):
                return size, value
            byte = raw[at[alive] + depth].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.units)
            unit = self.units[np.where(inside, node, 0)]
            on = inside & (unit & 0x800000FF == byte)
            alive, node, unit, depth = alive[on], (node ^ offset(unit))[on], unit[on], depth + 1
            leaf = (unit >> 8 & 1) == 1
            size[alive[leaf]], value[alive[leaf]] = depth, self.units[node[leaf]] & 0x7FFFFFFF

    def normalise(self, raw: np.ndarray, sizes: np.ndarray) -> Normalised:
        """Normalise joined texts of the given sizes in bytes."""
        sizes = np.asarray(sizes, dtype=np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if self.units is None and not self.squeeze:
            data, origin, bounds = raw, np.arange(len(raw)), ends
            head, stop = begins, ends
        else:
            data, origin, bounds, head, stop = self._replaced(raw, begins, ends)
        if self.prefix:  # a space sign before each text that isn't empty
            first = np.concatenate([[0], bounds[:-1]]) if len(bounds) else bounds
            some = sizes > 0 if not self.squeeze else bounds > first
            data = np.insert(data, first[some], 32)
            origin = np.insert(origin, first[some], head[some])
            bounds = bounds + np.cumsum(some)
        sign = np.flatnonzero(data == 0xE2)
        sign = sign[sign + 2 < len(data)]
        sign = sign[(data[sign + 1] == 0x96) & (data[sign + 2] == 0x81)]
        if len(sign):  # the sign itself in a text means a space, too
            data, keep = data.copy(), np.ones(len(data), dtype=bool)
            data[sign] = 32
            keep[sign + 1] = keep[sign + 2] = False
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            data, origin = data[keep], origin[keep]
        if self.squeeze:
            data, origin, bounds, stop = _trimmed(data, origin, bounds, stop)
        return Normalised(data, origin, bounds, stop)

    def _replaced(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        text_of = np.repeat(np.arange(len(ends)), ends - begins)
        at = np.flatnonzero(raw & 0xC0 != 0x80)
        own = np.diff(at, append=len(raw))
        size, value = self.longest(raw, at, ends[text_of[at]])
        if (size > own).any():  # a string of several characters takes those it covers along
            keep, place = np.ones(len(at), dtype=bool), 0
            for i in np.flatnonzero(size > own).tolist():
                if i < place:
                    continue
                place = int(np.searchsorted(at, at[i] + size[i]))
                keep[i + 1:place] = False
            at, own, size, value = at[keep], own[keep], size[keep], value[keep]
        changed = value >= 0
        length = np.where(changed, self.made_size[np.where(changed, value, 0)], own) if changed.any() else own
        source = np.where(changed, len(raw) + value, at)
        done = np.cumsum(length)
        data = np.concatenate([raw, self.made])[np.repeat(source - (done - length), length) + np.arange(int(done[-1]) if len(done) else 0)]
        origin, owner = np.repeat(at, length), text_of[at]
        head = begins.copy()
        if self.squeeze:
            unit = np.repeat(np.arange(len(at)), length)
            lead = (np.cumsum(data != 32) - np.concatenate([[0], np.cumsum(data != 32)])[(done - length)[unit]]) == 0  # spaces a unit starts with
            full = np.flatnonzero(length > 0)
            after = np.ones(len(at), dtype=bool)  # does the unit follow a space or a text's start?
            after[full[1:]] = (data[done[full[:-1]] - 1] == 32) | (owner[full[1:]] != owner[full[:-1]])
            keep = ~(lead & after[unit])
            # the added sign belongs to the first unit that isn't just a space
            other = np.flatnonzero(~((length == 1) & (data[np.minimum(done - length, max(len(data) - 1, 0))] == 32))) if len(data) else np.arange(len(at))
            firsts = np.searchsorted(at[other], begins) if len(other) else np.zeros(len(begins), dtype=np.int64)
            found = firsts < len(other)
            head[found] = np.minimum(at[other[firsts[found]]], ends[found])
        else:
            keep = np.ones(len(data), dtype=bool)
        made = np.bincount(np.repeat(owner, length)[keep], minlength=len(ends)) if len(data) else np.zeros(len(ends), dtype=np.int64)
        return data[keep], origin[keep], np.cumsum(made), head, ends.copy()


def _trimmed(data: np.ndarray, origin: np.ndarray, bounds: np.ndarray, stop: np.ndarray):
    """Spaces that texts end with go."""
    solid = np.flatnonzero(data != 32)
    starts = np.concatenate([[0], bounds[:-1]]) if len(bounds) else bounds
    last = np.searchsorted(solid, bounds) - 1
    new = np.where((last >= 0) & (solid[last] >= starts), solid[last] + 1, starts) if len(solid) else starts
    cut = new < bounds
    stop = np.where(cut, origin[np.minimum(new, max(len(data) - 1, 0))], stop) if len(data) else stop
    change = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(change, new[cut], 1)
    np.add.at(change, bounds[cut], -1)
    keep = np.cumsum(change[:-1]) == 0
    return data[keep], origin[keep], np.cumsum(new - starts), stop
