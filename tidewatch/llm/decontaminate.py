"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``n`` characters may occur with up to ``k = n // CHARS_PER_EDIT`` edits. Cut into ``k + 1`` pieces, at
least one piece must then occur unchanged; an automaton over all pieces finds every exact piece hit in one pass over
a text, and each hit's surroundings are verified with Myers' bit-parallel distance. Items and texts are compared
lower-cased, with runs of white space as one space.

Documents are never shuffled: the pieces go to the tasks. Items come in slabs of at most ``SLAB_CHARS`` characters,
which bounds what is broadcast; a larger test set takes another pass per slab.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name, held_by

CHARS_PER_EDIT = 20
SLAB_CHARS = 4_000_000
NEVER = 1 << 30
LEAK = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces ``(offset, text)`` of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Myers: the least distance of ``item`` to any part of ``text``, and where that part ends."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # no carry into the first row: a match may begin anywhere
        plus, minus = (plus << 1) & full, (minus << 1) & full
        vertical = eq | down
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def matched(item: str, text: str, edits: int) -> int:
    """How many of the last characters of ``text`` the item matches with ``edits`` edits; of several, what is nearest its length.

    The distances to the text's suffixes, from the end, in a band of ``edits`` on either side.
    """
    n, back = len(item), text[max(0, len(text) - len(item) - edits):][::-1]
    row = {j: j for j in range(min(edits, len(back)) + 1)}
    for i, c in enumerate(reversed(item), 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - edits), min(len(back), i + edits) + 1):
            new[j] = min(row.get(j, NEVER) + 1, new.get(j - 1, NEVER) + 1, row.get(j - 1, NEVER) + (j == 0 or back[j - 1] != c))
        row = new
    return min((j for j, d in row.items() if d <= edits), key=lambda j: (abs(j - n), j), default=min(n, len(text)))


class Matcher:
    """The automaton over the pieces of all items of a slab, built once per worker process."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.budget = [len(t) // CHARS_PER_EDIT for _, t in items]
        self.masks: list[dict[str, int] | None] = [None] * len(items)
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.budget[i]):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, (len(piece), spots))
        self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, items: list[tuple[int, str]]) -> Matcher:
        kept = held_by("decontaminate")
        if key not in kept:
            kept[key] = cls(items)
        return kept[key]

    def leaks(self, text: str) -> list[dict]:
        """The best match of every item that occurs within its budget."""
        begins: dict[int, set[int]] = {}
        for end, (size, spots) in self.automaton.iter(text):
            for i, offset in spots:
                begins.setdefault(i, set()).add(end + 1 - size - offset)
        found = []
        for i, diagonals in begins.items():
            k, (item_id, item) = self.budget[i], self.items[i]
            best = (k + 1, 0)
            for d in sorted(diagonals):
                # a true match begins and ends within k of its diagonal
                low = max(0, d - k)
                if k == 0:
                    edits, end = 0, len(item)
                else:
                    if self.masks[i] is None:
                        m: dict[str, int] = {}
                        for j, c in enumerate(item):
                            m[c] = m.get(c, 0) | 1 << j
                        self.masks[i] = m
                    edits, end = best_match(item, self.masks[i], text[low:d + len(item) + k])
                best = min(best, (edits, low + end))
                if best[0] == 0:
                    break
            if best[0] <= k:
                found.append({"item_id": item_id, "edits": best[0], "start": best[1] - matched(item, text[:best[1]], best[0]), "end": best[1]})
        return sorted(found, key=lambda x: x["item_id"])


def _slabs(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    slab, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if item_id is None or not (t := normal(text)):
            continue
        if slab and size + len(t) > SLAB_CHARS:
            yield slab
            slab, size = [], 0
        slab.append((item_id, t))
        size += len(t)
    if slab:
        yield slab


def _finder(shared, key: str):
    def leaks(texts: pd.Series) -> pd.Series:
        matcher = Matcher.of(key, shared.value)
        return pd.Series([matcher.leaks(normal(t)) if t else [] for t in texts], dtype=object)

    return leaks


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """``docs`` with an array column ``name`` of the items each text holds, with their edits and place.

    Places count characters of the normalised text. Null and empty texts hold nothing, items without text or id
    are left out, repeated items each count, all other columns pass through.
    """
    sc = docs.sparkSession.sparkContext
    parts = []
    for slab in _slabs(benchmark):
        shared, key = sc.broadcast(slab), uuid.uuid4().hex
        parts.append(F.pandas_udf(_finder(shared, key), LEAK)(F.col("text").cast("string")))
    empty = F.array().cast(LEAK)
    return docs.withColumn(name, reduce(lambda a, b: F.concat(a, b), parts) if parts else empty)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: one row per document and item it holds within the error budget."""
    own = docs.select("doc_id", "text")
    return with_leaks(own, benchmark, "leak").select("doc_id", F.explode("leak").alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns as they are."""
    name = free_name(docs, "leaks")
    return with_leaks(docs, benchmark, name).where(F.size(F.col(name)) == 0).drop(name)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int, int]]:
    """``(doc_id, item_id, edits)`` by the full dynamic-programming table, for tests."""
    out = set()
    for item_id, raw in items:
        item = normal(raw)
        for doc_id, text in docs:
            if not item or item_id is None or not (t := normal(text)):
                continue
            row = np.zeros(len(t) + 1, int)
            for i, c in enumerate(item):
                new = [i + 1]
                for j, d in enumerate(t):
                    new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
                row = np.array(new)
            if (edits := int(row.min())) <= len(item) // CHARS_PER_EDIT:
                out.add((doc_id, item_id, edits))
    return out
