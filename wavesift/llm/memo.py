"""Ids of text parts remembered by a worker, in flat arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class IdMemo:
    """Entry numbers of keys; each entry is a run of ids. Full memory starts anew.

    Entry 0 is ``reserved``, an id run that belongs to no key. Keys are held sorted, so
    a million of them take some tens of megabytes.
    """

    def __init__(self, kind, reserved: list[int], max_entries: int, max_ids: int = 1 << 24):
        self.kind, self.reserved, self.max_entries, self.max_ids = kind, reserved, max_entries, max_ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.entry = np.empty(0, np.int32)
        self.flat = np.zeros(1 << 16, self.kind)
        self.at = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0
        self._append(np.array(self.reserved, self.kind), np.array([len(self.reserved)]))

    def _append(self, new: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(sizes) > len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
        self.flat[self.used : self.used + len(new)] = new
        self.at[self.count : self.count + len(sizes)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size[self.count : self.count + len(sizes)] = sizes
        self.used += len(new)
        self.count += len(sizes)

    def entries(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Entry of each of the sorted distinct keys; ``make`` gives the ids of the keys at some positions and how many each has."""
        if self.count + len(keys) > self.max_entries or self.used > self.max_ids:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        entry = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            near = np.minimum(place, len(self.keys) - 1)
            known = self.keys[near] == keys
            entry[known] = self.entry[near[known]]
        missing = np.flatnonzero(entry < 0)
        for lo in range(0, len(missing), 20_000):
            part = missing[lo : lo + 20_000]
            entry[part] = np.arange(self.count, self.count + len(part))
            self._append(*make(part))
        self.keys = np.insert(self.keys, place[missing], keys[missing])
        self.entry = np.insert(self.entry, place[missing], entry[missing])
        return entry

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a row of entries, and the running total of ids before each entry."""
        size = self.size[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(total[-1]) + np.repeat(self.at[entry] - total[:-1], size)
        return self.flat[flat], total
