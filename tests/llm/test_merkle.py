import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewatch.llm import merkle
from tidewatch.llm.queries import op11


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, add=0):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, source, lang, n_chars, text = row
    return H(*map(one, (doc_id, source, lang, None if n_chars is None else n_chars + add, text)))


def levels(leaves):
    """Every level of a tree, by the definition: runs of two, the last one of one or two."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """Multiset of the contract's rows, from whole levels in memory."""
    order = lambda v: (v is not None, v)
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf_of(r) for r in sorted(groups[g], key=lambda r: (order(r[0]), leaf_of(r)))]) for g in names}
    tops = levels([trees[g][-1][0] for g in names])
    root, out = tops[-1][0], []
    for number, g in enumerate(names):
        for place, row in enumerate(sorted(groups[g], key=lambda r: (order(r[0]), leaf_of(r)))):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            at, siblings = leaf_of(row, 1 if tampered else 0), ""
            for tree, spot in ((trees[g], place), (tops, number)):
                for level in tree[:-1]:
                    other = level[spot ^ 1] if spot ^ 1 < len(level) else ""
                    siblings += other
                    at = H(at, other) if spot % 2 == 0 else H(other, at)
                    spot //= 2
            out.append((row[0], leaf_of(row), trees[g][-1][0], root, H(siblings), at, at == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows, tmp_path, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("node", F.lit("x")).withColumn("root", F.lit(0))
    monkeypatch.setattr(op11, "table", lambda *_: docs.repartition(5))
    got = op11.op11_merkle_manifest(spark, "")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(sizes, seed=3):
    rng, rows, i = random.Random(seed), [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 3)
            rows.append((i, rng.choice(["s", "", None, "quelle:é"]), lang, rng.choice([None, i % 90]), rng.choice([None, "", "text é\n" * (i % 4)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1300, None: 3, "": 1, "de": 512, "fr": 513, "é": 2, "z": 1},
    {f"l{i}": 1 + i % 2 for i in range(600)},
    {"only": 1}, {"only": 1025}], ids=["blocks", "many groups", "one row", "one group"])
def test_equals_whole_levels_in_memory(spark, tmp_path, monkeypatch, sizes):
    rows = rows_of(sizes)
    got = run(spark, rows, tmp_path, monkeypatch)
    assert got == brute(rows)
    assert len({r[3] for r in got}) == 1
    if len(rows) > 100:
        assert 0 < sum(not r[6] for r in got) < len(rows) / 4


def test_repeated_rows_null_ids_and_odd_texts(spark, tmp_path, monkeypatch):
    rows = [(i, "s", "en", None if t is None else len(t), t) for i, t in ODD] + [(7, "s", "en", 4, "same")] * 700 + [(None, None, None, None, None)] * 3
    assert run(spark, rows, tmp_path, monkeypatch) == brute(rows)
    assert run(spark, [], tmp_path, monkeypatch) == []


def test_frontier_extends_witnesses_as_siblings_complete():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    for n in range(1, 12):
        own = merkle.Frontier(1)
        for i, d in enumerate(digests[:n]):
            own.append(d)
            # the open subtrees are the binary digits of the count, and each witness leads to its own subtree
            assert sum(1 << level for level, _, _ in own.open) == i + 1
            for leaf in range(i + 1):
                top = next(t for t in reversed(own.open) if t[2] <= leaf)
                assert merkle.fold(digests[leaf], *own.witness(leaf)) == top[1]
        root = own.close()
        assert root.hex() == levels([d.hex() for d in digests[:n]])[-1][0]
        assert all(merkle.fold(digests[i], *own.witness(i)) == root for i in range(n))
        assert merkle.fold(digests[0], *(own.witness(n - 1))) != root or n == 1


def test_a_changed_text_or_a_foreign_proof_does_not_verify(spark):
    docs = spark.createDataFrame(rows_of({"en": 40, "de": 9}), SCHEMA)
    changed = {"text": F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))}
    proofs = merkle.verified(merkle.manifest(docs, op11.COLUMNS, "lang", "doc_id", changed)).collect()
    assert all((r.folded_root == r.root) == (r.doc_id % 2 == 1) for r in proofs) and len(proofs) == 49
    honest = [r for r in proofs if r.shown == r.leaf]
    a, b = next((a, b) for a in honest for b in honest if a.leaf != b.leaf)
    assert merkle.fold(bytes(a.leaf), bytes(b.siblings), b.path.encode()) != bytes(a.root)
