"""Sorted values under insertion, in counted blocks: the order structure of expanding quantiles, in batch and as stream state.

The index holds, per block of neighbouring values, the lowest value and the count; the values themselves lie in blocks of
at most ``WIDE``, fetched when an insertion or a rank falls into them. So a step touches one or two blocks however many
values there are, and a stream reads and writes no more of its state than that.
"""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections.abc import Callable

WIDE = 512


def packed(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}d", *values)


def unpacked(cell: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(cell) // 8}d", cell))


class Counted:
    """``index`` is ``(lows, counts, ids)``; ``fetch`` gives the values of a block that is not in memory."""

    def __init__(self, index: tuple[list[float], list[int], list[int]] | None = None, fetch: Callable[[int], list[float]] | None = None):
        self.lows, self.counts, self.ids = (list(x) for x in index) if index else ([], [], [])
        self.fetch, self.blocks, self.changed = fetch, {}, set()
        self.size, self.next = sum(self.counts), max(self.ids, default=-1) + 1

    def _block(self, at: int) -> list[float]:
        number = self.ids[at]
        if number not in self.blocks:
            self.blocks[number] = self.fetch(number)
        return self.blocks[number]

    def _new(self, at: int, values: list[float]) -> None:
        self.lows.insert(at, values[0])
        self.counts.insert(at, len(values))
        self.ids.insert(at, self.next)
        self.blocks[self.next] = values
        self.changed.add(self.next)
        self.next += 1

    def extend_sorted(self, values: list[float]) -> None:
        """Sorted values, none below those held, as whole blocks."""
        for i in range(0, len(values), WIDE):
            self._new(len(self.ids), list(values[i:i + WIDE]))
        self.size += len(values)

    def insert(self, value: float) -> None:
        self.size += 1
        if not self.ids:
            self._new(0, [value])
            return
        at = max(0, bisect_right(self.lows, value) - 1)
        block = self._block(at)
        insort(block, value)
        self.changed.add(self.ids[at])
        self.lows[at], self.counts[at] = block[0], len(block)
        if len(block) > WIDE:
            upper = block[len(block) // 2:]
            del block[len(block) // 2:]
            self.counts[at] = len(block)
            self._new(at + 1, upper)

    def at(self, rank: int) -> float:
        """The value of a rank, from 0."""
        for i, count in enumerate(self.counts):
            if rank < count:
                return self._block(i)[rank]
            rank -= count
        raise IndexError(rank)

    def quantile(self, q: float, hidden: int = 0, total: int | None = None) -> float | None:
        """Linear interpolation among ``total`` values (those held), ``hidden`` of which lie below those held."""
        n = self.size if total is None else total
        if not n:
            return None
        place = q * (n - 1)
        low = int(place)
        high = min(low + 1, n - 1)
        bottom = self.at(low - hidden)
        return bottom + (self.at(high - hidden) - bottom) * (place - low)
