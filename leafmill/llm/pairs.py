"""Pair merging on numbered tokens with a bounded cache."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Entries of a generation of a worker's cache; the bound changes speed and no result.
CACHE = 100_000
_SHIFT = 20  # token numbers are below 2 ** 20
_NONE = 1 << 60


class Merges:
    """Which neighbours join: the rank of each pair of token numbers, and the number of what a rank makes."""

    def __init__(self) -> None:
        self.ranks: dict[int, int] = {}
        self.made: dict[int, int] = {}

    def add(self, left: int, right: int, rank: int, made: int) -> None:
        self.ranks[left << _SHIFT | right] = rank
        self.made[rank] = made

    def merge(self, parts: list[int]) -> list[int]:
        """``parts`` with neighbours joined, lowest rank first and leftmost among equals."""
        if len(parts) > 48:
            return self._merge_long(parts)
        get, made = self.ranks.get, self.made
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << _SHIFT | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << _SHIFT | parts[i], _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs: n log n steps, for pre-tokens of up to millions of bytes."""
        get, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << _SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been joined meanwhile; joined right halves are -1
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get(parts[i] << _SHIFT | parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (k := before[i]) >= 0 and (r := get(parts[k] << _SHIFT | parts[i])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
        return [p for p in parts if p >= 0]


class Cached:
    """``find(slice)`` with what has been found before, in two generations: when the young one is full it becomes
    the old one, so what is asked for often stays and memory is bounded."""

    def __init__(self, find: Callable[[bytes], T], most: int = CACHE) -> None:
        self.find, self.most, self.young, self.old = find, most, {}, {}

    def __call__(self, key: bytes) -> T:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.find(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found
