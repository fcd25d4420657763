"""Byte pair merges of one word, shared by the token counter and the piece encoder."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

SHORT = 32
NEVER = float("inf")


class Memory(dict):
    """Values worked out once per key and remembered, the last ``size`` to twice as many.

    When the young half is full it becomes the old half; a key found there moves back.
    """

    def __init__(self, make: Callable, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def unmet(self, keys) -> list:
        """Those of different ``keys`` that neither half has."""
        return [key for key in keys if key not in self and key not in self.old]


def merged(parts: list[str], rank: Callable) -> list[str]:
    """``parts`` after all merges: the adjacent pair of lowest rank first, the leftmost of equals.

    ``rank(a, b)`` is ``NEVER`` for a pair that has no merge. Short words are searched anew
    for each merge; long ones keep their pairs in a heap, so a text without blanks takes
    n log n steps.
    """
    if len(parts) > SHORT:
        return merged_by_heap(parts, rank)
    parts = list(parts)
    ranks = list(map(rank, parts, parts[1:]))
    while ranks:
        least = min(ranks)
        if least == NEVER:
            break
        at = ranks.index(least)
        parts[at] += parts.pop(at + 1)
        del ranks[at]
        if at:
            ranks[at - 1] = rank(parts[at - 1], parts[at])
        if at < len(ranks):
            ranks[at] = rank(parts[at], parts[at + 1])
    return parts


def merged_by_heap(parts: list[str], rank: Callable) -> list[str]:
    """The same with the candidate pairs in a heap and the parts in a linked list."""
    parts, n = list(parts), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    version = [0] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = rank(parts[i], parts[j])
            if r != NEVER:
                heapq.heappush(heap, (r, i, version[i], j, version[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, at_i, j, at_j = heapq.heappop(heap)
        if version[i] != at_i or version[j] != at_j:
            continue
        parts[i] += parts[j]
        version[i] += 1
        version[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p, v in zip(parts, version, strict=True) if v >= 0]


# --- many words at once ---------------------------------------------------------------
PART_BITS = 22  # of the number of a part
PART = (1 << PART_BITS) - 1
UNMERGED = (1 << 63) - 1
SPREAD = np.int64(6_700_417)  # over 2^22; a pair of parts is the number left * SPREAD + right


class PairTable:
    """What pairs of numbered parts merge to: an open hash table in two arrays."""

    def __init__(self, left: list[int], right: list[int], values: list[int]):
        keys = np.array(left, np.int64) * SPREAD + np.array(right, np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, UNMERGED, np.int64)
        values, slot = np.array(values, np.int64), self._slot(keys)
        while len(keys):  # of those that want one slot one gets it, the rest goes on to the next
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, ``UNMERGED`` where there is none."""
        keys = left.astype(np.int64) * SPREAD + right
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], UNMERGED)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[open_]]
            same = here == keys[open_]
            found[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (here != -1)]
        return found


def merged_rows(parts: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(parts, sizes) after all merges; a row of ``parts`` holds the numbers of a word's characters.

    Each round merges in every word that still can its pair of lowest value, the leftmost of
    equals. A value holds the rank, and in its last bits the number of what comes of the pair.
    """
    parts, sizes = parts.copy(), sizes.copy()
    width = parts.shape[1]
    if width < 2:
        return parts, sizes
    place = np.arange(width)
    ranks = table.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), width - 1)
    ranks[place[None, 1:] >= sizes[:, None]] = UNMERGED
    live = np.arange(len(parts))
    while len(live):
        at = ranks.argmin(axis=1)
        row = np.arange(len(live))
        least = ranks[row, at]
        going = least != UNMERGED
        if not going.all():
            live, at, least, ranks = live[going], at[going], least[going], ranks[going]
            row = np.arange(len(live))
        if not len(live):
            break
        own = parts[live]
        own[row, at] = least & PART
        # what stands behind the pair moves up by one
        source = np.minimum(place[None, :] + (place[None, :] > at[:, None]), width - 1)
        own = np.take_along_axis(own, source, axis=1)
        ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 2), axis=1)
        sizes[live] -= 1
        size = sizes[live]
        parts[live] = own
        new = own[row, at]
        before, after = at > 0, at + 1 < size
        ranks[row[before], at[before] - 1] = table.find(own[row[before], at[before] - 1], new[before])
        ranks[row[after], at[after]] = table.find(new[after], own[row[after], at[after] + 1])
        ranks[place[None, 1:] >= size[:, None]] = UNMERGED
    return parts, sizes
