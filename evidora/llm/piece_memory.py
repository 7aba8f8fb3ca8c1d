"""Ids of pieces in flat arrays, looked up for a whole block of texts at once.

A piece is found by its 64-bit hash (open addressing) and then compared code
point by code point, so a clash of hashes never gives the ids of another piece.
An entry takes about 50 bytes besides 4 for each code point and id.
"""

from __future__ import annotations

import numpy as np

from .textblock import gather_ranges

_SLOTS = 1 << 12


def _filled(array: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` after its first ``used`` entries, grown by half where it is full."""
    end = used + len(values)
    if end > len(array):
        array = np.concatenate((array[:used], np.empty(max(end, used + used // 2) - used, array.dtype)))
    array[used:end] = values
    return array


class Table:
    """Hashes, code points and ids of pieces."""

    def __init__(self) -> None:
        self.n = 0
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.hashes = np.zeros(1, np.uint64)
        self.points, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.point_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)  # n + 1 of each

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.slots, self.hashes, self.points, self.ids, self.point_at, self.id_at))

    def find(self, hashes: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece ``cps[start:end]``, -1 where there is none."""
        entry = np.full(len(hashes), -1, np.int64)
        asked, slot = np.arange(len(hashes)), self._first_slot(hashes)
        while len(asked):
            there = self.slots[slot]
            other = self.hashes[there] != hashes[asked]
            hit = (there >= 0) & ~other
            entry[asked[hit]] = there[hit]
            on = (there >= 0) & other
            asked, slot = asked[on], slot[on] + 1 & len(self.slots) - 1
        at = np.flatnonzero(entry >= 0)
        lengths, known = ends[at] - starts[at], entry[at]
        same = lengths == self.point_at[known + 1] - self.point_at[known]
        entry[at[~same]] = -1
        at, lengths, known = at[same], lengths[same], known[same]
        differs = cps[gather_ranges(starts[at], lengths)] != self.points[gather_ranges(self.point_at[known], lengths)]
        if differs.any():
            entry[np.repeat(at, lengths)[differs]] = -1
        return entry

    def add(self, hashes: np.ndarray, points: np.ndarray, n_points: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """Add pieces, given one after the other; their entries."""
        old, self.n = self.n, self.n + len(hashes)
        self.points = _filled(self.points, self.point_at[old], points)
        self.ids = _filled(self.ids, self.id_at[old], ids)
        self.point_at = _filled(self.point_at, old + 1, self.point_at[old] + np.cumsum(n_points))
        self.id_at = _filled(self.id_at, old + 1, self.id_at[old] + np.cumsum(n_ids))
        self.hashes = _filled(self.hashes, old, hashes)
        entries = np.arange(old, self.n)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
            self._place(np.arange(self.n))
        else:
            self._place(entries)
        return entries

    def pieces(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries in the form that ``add`` takes."""
        n_points, n_ids = self.point_at[entries + 1] - self.point_at[entries], self.id_at[entries + 1] - self.id_at[entries]
        return self.hashes[entries], self.points[gather_ranges(self.point_at[entries], n_points)], n_points, self.ids[gather_ranges(self.id_at[entries], n_ids)], n_ids

    def _first_slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _place(self, entries: np.ndarray) -> None:
        slot = self._first_slot(self.hashes[entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]  # of several for one slot the last stays
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], slot[lost] + 1 & len(self.slots) - 1


class PieceMemory:
    """A memory of about ``limit`` bytes that forgets by age.

    It has a younger and an older table.  When the younger one holds half the
    limit, the older one is forgotten; what is asked for again becomes young again.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.young, self.old = Table(), Table()

    @property
    def size(self) -> int:
        return self.young.size + self.old.size

    def find(self, hashes: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry in ``young`` of each piece, -1 where it has to be added there."""
        if self.young.size > self.limit // 2:
            self.old = self.young if self.young.size <= self.limit else Table()
            self.young = Table()
        entry = self.young.find(hashes, cps, starts, ends)
        rest = np.flatnonzero(entry < 0)
        if self.old.n and len(rest):
            older = self.old.find(hashes[rest], cps, starts[rest], ends[rest])
            again = older >= 0
            entry[rest[again]] = self.young.add(*self.old.pieces(older[again]))
        return entry
