"""Rules along an order, by many tasks: rows are dealt into sorted stretches, and what crosses a border is a summary.

A stretch is one partition of a range partitioning by (keys, order): a key with most of the rows spans many stretches,
the others share one. Inside a stretch rows are walked in order; at its head the walk continues whatever stretch
came before, so it needs the state there. Two ways to get it:

* a rule whose summary of a stretch is a function of the state before it: summaries are chained per key (``flows``);
* any rule whose state soon forgets its past: stretches are walked from a guess, and again only where the state that the
  stretch before really ends with differs from the guess (``speculate``).
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import kept_apart

STRETCH = "_stretch"


def dealt(rows: DataFrame, keys: list[str], order: list[str], kept: list[str] | None = None) -> DataFrame:
    """``rows`` in stretches sorted by (keys, order), written: adds the stretch's number, ascending along the order.

    The rows are written once, so every walk over them sees the same stretches, also after an executor is lost; of their
    columns those ``kept`` (all, if not named), as the order may not be needed once they lie in it. The shuffle's files then go.
    """
    sorted_rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return kept_apart(sorted_rows.select(*(kept or rows.columns), F.spark_partition_id().alias(STRETCH)))


def key_changes(batch: pa.RecordBatch, columns: list[int]) -> pa.Array:
    """Per row after the first, whether any key column differs from the row before."""
    n = batch.num_rows
    changed = pa.array([False] * (n - 1), pa.bool_())
    for i in columns:
        here, before = batch.column(i).slice(1), batch.column(i).slice(0, n - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(here.is_null(), before.is_null()))
        changed = pc.or_(changed, differs)
    return changed


def key_at(batch: pa.RecordBatch, columns: list[int], row: int) -> tuple:
    return tuple(batch.column(i)[row].as_py() for i in columns)


def speculate(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any],
              step: Callable[..., tuple[Any, int]], output: str, rounds: int = 1000, kept: list[str] | None = None) -> DataFrame:
    """Adds BIGINT ``output``: ``state, value = step(state, *inputs)`` along ``order`` within ``keys``, stretches in parallel.

    The first walk guesses that nothing came before a stretch. Whenever a stretch ends in another state than the walk of
    the next one began with, that one is walked again; when none is left, every state is the one a single walk would
    have had. States must be comparable and small: one per stretch reaches the driver. A rule whose state forgets its past within a
    stretch takes two walks; one that never does takes a walk per stretch that a key spans. Only columns ``kept`` (all, if not
    named) are written and returned with it.
    """
    ready = dealt(rows, keys, order, list(dict.fromkeys([*(kept or rows.columns), *keys, *inputs])))
    spark = rows.sparkSession
    slim = ready.select(*dict.fromkeys([*keys, *inputs, STRETCH]))
    before: dict[int, tuple] = {}
    known: dict[int, tuple] = {}
    todo = None
    for _ in range(rounds):
        walk = _walk(slim.columns, keys, inputs, start, step, spark.sparkContext.broadcast(before))
        own = slim if todo is None else slim.where(F.col(STRETCH).isin(todo))
        for r in own.mapInArrow(_ends(walk, slim.columns, keys), "stretch int, cell binary").collect():
            known[r.stretch] = pickle.loads(r.cell)
        numbers = sorted(known)
        now = {b: known[a][1:] for a, b in zip(numbers, numbers[1:]) if known[a][1] == known[b][0]}
        todo = [n for n in numbers if now.get(n) != before.get(n)]
        before = now
        if not todo:
            break
    else:
        raise RuntimeError(f"states still change after {rounds} walks")

    names = ready.columns
    walk = _walk(names, keys, inputs, start, step, spark.sparkContext.broadcast(before))
    left = [i for i, n in enumerate(names) if n in (kept or rows.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out, _ in walk(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in left), pa.array(out, pa.int64())], names=[*(names[i] for i in left), output])

    schema = ", ".join(f"`{names[i]}` {ready.dtypes[i][1]}" for i in left) + f", `{output}` bigint"
    return ready.mapInArrow(run, schema)


def _walk(names: list[str], keys: list[str], inputs: list[str], start, step, before):
    """Walks a stretch's batches from the state ``before`` names for it: yields ``(batch, values, (last key, its state))``."""
    at, values_at, number_at = [names.index(k) for k in keys], [names.index(c) for c in inputs], names.index(STRETCH)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], tuple]]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = key_at(batch, at, 0)
            fresh = [head != last, *key_changes(batch, at).to_pylist()]
            if last is None:
                known = before.value.get(batch.column(number_at)[0].as_py())
                if known is not None and known[0] == head:
                    fresh[0], state = False, copy.deepcopy(known[1])  # steps may change a state in place
            out = []
            for new, values in zip(fresh, zip(*(batch.column(i).to_pylist() for i in values_at))):
                if new:
                    state = start()
                state, value = step(state, *values)
                out.append(value)
            last = key_at(batch, at, batch.num_rows - 1)
            yield batch, out, (last, state)

    return walk


def _ends(walk, names: list[str], keys: list[str]):
    """``(stretch, first key, last key and its state)`` of each stretch."""
    at, number_at = [names.index(k) for k in keys], names.index(STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, head, tail = None, None, None
        for batch, _, tail in walk(batches):
            if number is None:
                number, head = batch.column(number_at)[0].as_py(), key_at(batch, at, 0)
        if number is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((head, *tail))], pa.binary())], ["stretch", "cell"])

    return run
