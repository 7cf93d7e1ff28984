"""Conversation prefix trie by truncation peeling: its nodes, and what each subtree shares.

A node is a distinct sequence of first turns. Peeling goes from the deepest turn to the root: at each depth the conversations
that end there join the nodes that survived from below, and all with the same turns become one node, with its totals; then
every node loses its last turn and is grouped anew one level up. So each node is found and aggregated in the same step.

A conversation travels as its *path*: per turn 16 bytes of SHA-256 over (role, text) and 8 bytes of length, so truncation is
a substring and equal prefixes are equal bytes; no text is shuffled. Equal conversations are one row from the start, with
their number. A depth costs one shuffle with map-side combining, so a prefix that a third of all conversations share is
folded before it travels.

Long tails cost no rounds: where no other path shares a prefix, nothing can merge on the way there, and the nodes of that tail
follow in closed form. Prefixes are probed at depths 1, 2, 4, ...; a path enters the rounds at the first probed depth where it is
alone (or at its end). Rounds number at most twice the longest prefix that different conversations share.

The ids that end at a node are sorted by range and joined to texts of up to ``CHUNK`` ids by many tasks; one task per node then only feeds
these texts to SHA-256, which has to run in order, with constant memory.

Defined results: a null role or text is empty; turns are ordered by their number, nulls first, then by the turn's digest;
rows without a conversation id are left out; an empty table gives no rows; other columns are not read. One conversation's turns (24 bytes
each) sit in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: bytes a turn takes in a path
TURN = 24
CHUNK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def _depth(path: Column) -> Column:
    return (F.octet_length(path) / TURN).cast("int")


def _prefix(path: Column, depth: Column) -> Column:
    return F.substring(path, F.lit(1), (depth * TURN).cast("int"))


def _last_bytes(path: Column) -> Column:
    """Length of the last turn's text; 0 for the root."""
    return F.coalesce(F.conv(F.hex(F.substring(path, -8, 8)), 16, 10).cast("long"), F.lit(0).cast("long"))


def paths(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path)`` per conversation of ``conversations(conv_id, turn, role, text)``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    step = F.concat(own, F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), step.alias("step")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    # an empty binary in front keeps the type where there is no turn
    return turns.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["step"])), "")).alias("path"))


def regrafted(own: DataFrame, base: Column, head: Column) -> DataFrame:
    """``own(conv_id, path)`` with the first ``head`` turns of each path replaced by those of conversation ``base``."""
    donors = own.select(F.col("conv_id").alias("donor"), F.col("path").alias("donor_path"))
    rows = own.select("conv_id", "path", base.alias("donor"), head.cast("int").alias("head")).join(donors, "donor", "left")
    first = F.coalesce(_prefix(F.col("donor_path"), F.col("head")), F.unhex(F.lit("")))
    rest = F.substring(F.col("path"), F.col("head") * TURN + 1, F.octet_length("path"))
    return rows.select("conv_id", F.concat(first, rest).alias("path"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, conv_id)`` -> ``(key, first, ids)``, the decimal ids of up to ``CHUNK`` neighbours with a key, comma-joined."""
    key, ids = None, []

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or len(ids) == CHUNK):
                yield chunk()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield chunk()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, first, ids)`` -> ``(first, ends)``: SHA-256 over all ids of a key."""
    key = state = first = None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([state.hexdigest()])], ["first", "ends"])

    for batch in batches:
        for k, low, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                yield row()
            key, first, state = k, low, hashlib.sha256(ids.encode())
    if state is not None:
        yield row()


def _ends(own: DataFrame) -> DataFrame:
    """``(ended, ends)``: per distinct path its smallest conversation and the digest of all."""
    ids = own.select(F.unhex(F.substring(F.sha2("path", 256), 1, 32)).alias("key"), "conv_id")
    chunks = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "ended long, ends string")


def _saved_below(paths: pa.Array, enters: pa.Array, n: pa.Array) -> pa.Array:
    """What each node below depth ``enters`` saves with all below it, when ``n`` equal conversations are its only members."""
    out = []
    for path, top, members in zip(paths.to_pylist(), enters.to_pylist(), n.to_pylist()):
        lengths = np.frombuffer(path, ">i8").reshape(-1, 3)[top:, 2].astype(np.int64)
        out.append((np.cumsum(lengths[::-1]) * (members - 1))[::-1])
    return pa.array(out, pa.list_(pa.int64()))


def _entering(distinct: DataFrame) -> DataFrame:
    """``distinct(path, conv_id, n)`` with ``enters``, the depth at which a path joins the rounds, and ``saved`` of each node below."""
    path = F.col("path")
    probes = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(_depth(path), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    own = distinct.where(F.octet_length("path") > 0).select("conv_id", "path", F.explode(probes).alias("probe"))
    shared = own.groupBy("probe", F.sha2(_prefix(path, F.col("probe")), 256).alias("digest")).agg(F.count("*").alias("paths"), F.min("conv_id").alias("conv_id"))
    alone = shared.where("paths = 1").groupBy("conv_id").agg(F.min("probe").alias("alone"))
    rows = distinct.join(alone, "conv_id", "left").select("conv_id", "path", "n", F.least(F.col("alone"), _depth(path)).alias("enters"))
    return rows.withColumn("saved", F.arrow_udf(_saved_below, "array<bigint>")("path", "enters", "n"))


def _tails(entering: DataFrame) -> DataFrame:
    """The nodes below the depth at which a path enters: each has the same members, and one child or none."""
    rows = entering.select("conv_id", "n", "enters", F.size("saved").alias("length"), F.posexplode("saved").alias("place", "saved_tokens"))
    last = F.col("place") == F.col("length") - 1
    return rows.select("conv_id", (F.col("enters") + F.col("place") + 1).cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                       F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens",
                       F.when(last, F.col("conv_id")).alias("ended"))


_COLUMNS = ("path", "conv_id", "n_convs", "children", "leaves", "saved", "ended")


def _peeled(entering: DataFrame) -> list[DataFrame]:
    """The nodes of each depth, from the deepest at which a path enters to the root."""
    path = F.col("path")
    tail = (F.size("saved") > 0).cast("long")
    arrived = cut_lineage(entering.select(
        "enters", _prefix(path, F.col("enters")).alias("path"), "conv_id", F.col("n").alias("n_convs"), tail.alias("children"), tail.alias("leaves"),
        F.coalesce(F.get("saved", F.lit(0)), F.lit(0)).alias("saved"), F.when(tail == 0, F.col("conv_id")).alias("ended")))
    deepest = arrived.agg(F.max("enters")).first()[0]
    found, survivors = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = arrived.where(F.col("enters") == level).select(*_COLUMNS)
        if survivors is not None:
            here = here.unionByName(survivors)
        nodes = here.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("children").alias("children"),
                                         F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ended").alias("ended"))
        nodes = nodes.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")))
        nodes = cut_lineage(nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * _last_bytes(path)))
        found.append(nodes.withColumn("depth", F.lit(level).cast("long")))
        survivors = nodes.select(_prefix(path, F.lit(level - 1)).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("children"),
                                 "leaves", "saved", F.lit(None).cast("long").alias("ended"))
    return found


def trie(own: DataFrame) -> DataFrame:
    """Every node of the trie of ``own(conv_id, path)``, ids unique: the smallest member, depth, the parent's smallest member, members,
    children, leaves below, bytes saved if shared prefixes were stored once, and the digest of the ids that end there."""
    own = cut_lineage(own)
    distinct = own.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    entering = cut_lineage(_entering(distinct))
    levels = _peeled(entering)
    tails = _tails(entering)
    if not levels:
        nodes = tails
    else:
        rows = reduce(DataFrame.unionByName, levels)
        key = lambda path: F.sha2(path, 256)
        # the root's children may be many: its smallest member is one number, the others find their parents by path
        root = levels[-1].first()["conv_id"]
        parents = rows.where("depth > 0 and children > 0").select(key(F.col("path")).alias("parent"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"))
        placed = rows.withColumn("above", F.col("depth") - 1).withColumn("parent", F.when(F.col("depth") > 1, key(_prefix(F.col("path"), F.col("depth") - 1))))
        placed = placed.join(parents, ["parent", "above"], "left")
        nodes = placed.select("conv_id", "depth", F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_conv_id")).cast("long").alias("parent_conv_id"), "n_convs",
                              F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ended").unionByName(tails)
    return nodes.join(_ends(own), "ended", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
