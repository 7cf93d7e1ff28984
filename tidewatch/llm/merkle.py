"""Merkle dataset manifest: a root per group of rows and over all groups, and a proof per row, kept as incremental witnesses.

Leaves are appended in order. A *frontier* holds the open subtrees, each a complete run of 2 ** k leaves at an aligned place, and
with each the partial witnesses of its leaves: the siblings met so far. When an append completes a sibling, the two
become one open subtree and every witness in either is extended by the other's digest. ``close`` does the same for the last
run, where a node may have no sibling: it is hashed alone, and its witnesses note an empty step.

The append is distributed by aligned blocks of ``BLOCK`` leaves: a task streams one block through a frontier and gives its root.
Block roots are leaves of the next round, appended by the same code, until each group is one root; the roots of the
groups, in order, are one more such tree. A row's proof is its witness in its block, then its block's, and so on: what
is joined on the way is narrow (digests, no texts), by (group, block), and no task holds more than a block. Rounds
number log(rows) / log(``BLOCK``). Places in a group come from a range partitioning and the sizes of its ranges.

H is SHA-256; what is hashed is the lowercase hex of digests put together, so proofs can be checked with any tool.
A leaf is H over the row's values, each ``-`` if null, else its length in bytes, ``:`` and the value.

Defined results: a null group comes before all others; a null order value comes first in its group; rows with equal order
values stand by leaf digest, and equal rows have equal leaves, but each its own place and proof. A lone leaf is its
group's root, a lone group's root the root. An empty table gives no rows. Columns besides those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: levels and leaves of a block
BITS = 9
BLOCK = 1 << BITS
WIDTH = 32
#: steps of a path: the sibling stands to the right, to the left, or there is none
RIGHT, LEFT, ALONE = b"r", b"l", b"-"


def parent(*digests: bytes) -> bytes:
    """H of one or two digests, taken as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Frontier:
    """The open subtrees of a tree under append, and the partial witnesses of its leaves."""

    def __init__(self, levels: int = BITS):
        self.siblings = np.zeros((2, levels, WIDTH), np.uint8)
        self.steps = np.zeros((2, levels), "S1")
        self.open: list[tuple[int, bytes, int]] = []  # level, digest, first leaf; levels fall from left to right
        self.count = 0

    def append(self, digest: bytes) -> None:
        """One more leaf; every subtree that it completes extends its witnesses."""
        if self.count == len(self.steps):
            self.siblings = np.concatenate([self.siblings, np.zeros_like(self.siblings)])
            self.steps = np.concatenate([self.steps, np.zeros_like(self.steps)])
        self.open.append((0, digest, self.count))
        self.count += 1
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._join()

    def _room(self, level: int) -> None:
        if level == self.steps.shape[1]:
            self.siblings = np.concatenate([self.siblings, np.zeros_like(self.siblings[:, :1])], axis=1)
            self.steps = np.concatenate([self.steps, np.zeros_like(self.steps[:, :1])], axis=1)

    def _join(self) -> None:
        level, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        self._room(level)
        self.siblings[first:middle, level] = np.frombuffer(right, np.uint8)
        self.steps[first:middle, level] = RIGHT
        self.siblings[middle:self.count, level] = np.frombuffer(left, np.uint8)
        self.steps[middle:self.count, level] = LEFT
        self.open.append((level + 1, parent(left, right), first))

    def _lift(self) -> None:
        level, digest, first = self.open.pop()
        self._room(level)
        self.steps[first:self.count, level] = ALONE
        self.open.append((level + 1, parent(digest), first))

    def close(self, height: int = 0) -> bytes:
        """The root: nodes without a sibling are hashed alone until one remains, and that one up to level ``height``."""
        while len(self.open) > 1:
            if self.open[-2][0] == self.open[-1][0]:
                self._join()
            else:
                self._lift()
        while self.open[-1][0] < height:
            self._lift()
        return self.open[0][1]

    def witness(self, leaf: int) -> tuple[bytes, bytes]:
        """``(siblings, path)`` of one leaf so far, from the leaf upwards."""
        steps = self.steps[leaf]
        return self.siblings[leaf][(steps == RIGHT) | (steps == LEFT)].tobytes(), b"".join(steps.tolist())


def fold(leaf: bytes, siblings: bytes, path: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    at = 0
    for step in path:
        if step == ALONE[0]:
            leaf = parent(leaf)
            continue
        other = siblings[at:at + WIDTH]
        at += WIDTH
        leaf = parent(leaf, other) if step == RIGHT[0] else parent(other, leaf)
    return leaf


def _appended(carry: list[str]) -> Callable[[pa.Table], pa.Table]:
    """One aligned block of ``(tree, size, place, node, *carry)`` through a frontier."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        own = Frontier()
        for digest in block.column("node").to_pylist():
            own.append(digest)
        # a block of a larger tree reaches the height of a whole one, so that block roots are aligned leaves again
        top = own.close(BITS if block.column("size")[0].as_py() > BLOCK else 0)
        found = [own.witness(i) for i in range(own.count)]
        made = [pa.array([top] * own.count, pa.binary()), pa.array([s for s, _ in found], pa.binary()), pa.array([p.decode() for _, p in found], pa.string())]
        kept = ["tree", "size", "place", *carry]
        return pa.Table.from_arrays([*(block.column(c) for c in kept), *made], names=[*kept, "top", "siblings", "path"])

    return run


def grown(nodes: DataFrame, largest: int, carry: list[str] = (), over: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``nodes(tree, size, place, node, *carry)`` with the root of their tree as ``top`` and their witness in it.

    ``place`` counts from 0 in each tree of ``size`` nodes, at most ``largest``. ``over`` maps the trees' roots ``(tree, top)``
    to ``(tree, root, siblings, path)``, their witnesses in a tree of trees; then rows also have ``root``, and their witness
    leads there.
    """
    carry = list(carry)
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("tree", "size", "place", *carry)) + ", top binary, siblings binary, path string"
    block = F.shiftright("place", BITS)
    rows = (nodes.select("tree", "size", "place", "node", *carry, block.alias("block")).groupBy("tree", "block")
            .applyInArrow(_appended(carry), schema))
    if largest <= BLOCK and over is None:
        return rows
    rows = cut_lineage(rows)
    if largest <= BLOCK:
        above, on = over(rows.where("place = 0").select("tree", "top")), ["tree"]
        tops = [F.col("top"), F.col("root")]
    else:
        roots = rows.where(F.col("place") % BLOCK == 0).select(
            "tree", (F.shiftright(F.col("size") - 1, BITS) + 1).alias("size"), block.alias("place"), F.col("top").alias("node"))
        above, on = grown(roots, (largest - 1 >> BITS) + 1, [], over).withColumnRenamed("place", "block").withColumnRenamed("top", "top_above").drop("size"), ["tree", "block"]
        tops = [F.col("top_above").alias("top")] + ([F.col("root")] if over else [])
    above = above.withColumnsRenamed({"siblings": "siblings_above", "path": "path_above"})
    return rows.withColumn("block", block).join(above, on).select(
        "tree", "size", "place", *carry, *tops, F.concat("siblings", "siblings_above").alias("siblings"), F.concat("path", "path_above").alias("path"))


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows(tree, ...)`` with ``place`` by ``order`` in their tree and its ``size``; and the size of the largest tree.

    Ranges of (tree, order) are sorted by many tasks; the place is the row's number in its range plus what earlier ranges hold of the
    tree. A row number breaks ties of the ranges alone, so any number of equal rows is spread.
    """
    number = F.monotonically_increasing_id()
    dealt = rows.withColumn("tie", number).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).withColumn("number", number))
    ranges = dealt.groupBy("tree", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cut_lineage(ranges.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size")))
    largest = ranges.agg(F.max("size")).first()[0] or 0
    return dealt.join(ranges, ["tree", "part"]).withColumn("place", F.col("number") + F.col("shift")).drop("part", "number", "shift"), largest


def leaf(values: list[Column]) -> Column:
    """H over values, each ``-`` if null, else its bytes' count, ``:`` and itself."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, values)), 256))


def manifest(rows: DataFrame, columns: list[str], group: str, order: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """``(order, leaf, shown, subroot, root, siblings, path)`` for every row: its leaf, the roots, and its witness up to the root.

    Leaves hold ``columns``, ascend by ``order`` in each ``group``, and groups by name. ``shown`` is the leaf after ``changed`` replaces
    column values: what someone presents who has only the data, not the tree. Digests are binary, ``path`` has a letter per level.
    """
    values = [F.col(c) for c in columns]
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"), F.col(order).alias("key"),
                         leaf(values).alias("node"), leaf([(changed or {}).get(c, F.col(c)) for c in columns]).alias("shown"))
    leaves = leaves.withColumn("shown", F.when(F.col("shown") != F.col("node"), F.col("shown")))
    nodes, largest = placed(leaves, ["key", "node"])

    def over(tops: DataFrame) -> DataFrame:
        groups, number = placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node")), ["name"])
        return grown(groups, number, ["name"]).select(F.col("name").alias("tree"), F.col("top").alias("root"), "siblings", "path")

    out = grown(nodes.withColumn("leaf", F.col("node")), largest, ["key", "leaf", "shown"], over)
    return out.select(F.col("key").alias(order), "leaf", F.coalesce("shown", "leaf").alias("shown"), F.col("top").alias("subroot"), "root", "siblings", "path")


def verified(proofs: DataFrame) -> DataFrame:
    """``proofs`` (as ``manifest`` gives them) with ``folded_root``, the root that ``shown`` and the witness lead to."""
    own = F.pandas_udf(lambda shown, siblings, path: (
        shown.combine(siblings, lambda s, w: (s, w)).combine(path, lambda sw, p: fold(*sw, p.encode()))), "binary")
    return proofs.withColumn("folded_root", own("shown", "siblings", "path"))
