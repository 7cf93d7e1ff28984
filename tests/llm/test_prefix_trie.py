import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie
from tidewatch.llm.queries import op12

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1] or 0))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """The contract's rows by following every prefix of every conversation."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, saved, leaves = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node in sorted(members, key=len, reverse=True):
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = leaves.get(node, 0) + (node not in children)
        if node:
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children.get(node, 0), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("n", F.lit("x")).withColumn("depth", F.lit(0))
    monkeypatch.setattr(op12, "table", lambda *_: table.repartition(3))
    return collect(op12.op12_conversation_prefix_trie(spark, ""))


def conversations(seed, n=150, most=9):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n * 3), n):
        length = rng.choice([1, 2, 3, most])
        turns = list(range(length)) if rng.random() < 0.9 else [None, *range(1, length)]
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "a", "é\U0001f600", "", None, f"own {c}"])) for t in turns]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_prefix_by_hand(spark, monkeypatch, seed):
    rows = conversations(seed)
    assert run(spark, rows, monkeypatch) == brute(rebuilt(rows))


def test_copies_long_tails_and_deep_forks(spark, monkeypatch):
    talk = lambda c, n, text="t": [(c, t, "user", f"{text}{t}") for t in range(n)]
    rows = [r for c in range(0, 300, 5) for r in talk(c, 40, "same")]  # copies of one long conversation
    rows += talk(1000, 37, "same") + talk(1005, 300, f"alone") + [*talk(1010, 20, "fork"), (1010, 20, "user", "x")] + [*talk(1015, 20, "fork"), (1015, 20, "user", "y"), (1015, 21, "user", "z")]
    rows += [(2000, 0, "user", "w" * 200_000), (None, 0, "user", "nobody's")]
    assert run(spark, rows, monkeypatch) == brute(rebuilt(rows))


def test_empty_table_turnless_and_negative(spark, monkeypatch):
    assert run(spark, [], monkeypatch) == []
    rows = [(1, 0, "user", "only"), (6, 0, None, None), (5, 0, "user", "base")]
    turnless = [r for r in rebuilt([(c, 0, "u", "x") for c in range(1, 40) if c % 5]).values() if not r]
    assert turnless  # conversations whose turns are all replaced by those of a missing base
    rows += [(c, 0, "u", "x") for c in range(21, 60) if c % 5]
    assert run(spark, rows, monkeypatch) == brute(rebuilt(rows))


def test_ids_of_large_groups_are_hashed_in_order(spark):
    n = 3 * prefix_trie.CHUNK + 17
    own = spark.range(n, numPartitions=7).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 > 0, F.unhex(F.lit("00" * 24))).otherwise(F.unhex(F.lit(""))).alias("path"))
    got = {r.depth: r for r in prefix_trie.trie(own).collect()}
    for depth, ids in ((0, [i for i in range(n) if i % 3 == 0]), (1, [i for i in range(n) if i % 3])):
        assert got[depth].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0].n_convs == n and got[1].n_convs == n - len(range(0, n, 3))
