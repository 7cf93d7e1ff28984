"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A *block* holds whole documents in ascending id: ``control`` has two bits per token (its length less one, four tokens to a
byte, the first in the lowest bits), ``data`` the low bytes of its rank. Ranks order the ids by how often the whole corpus has
them, so the commonest 256 take one byte. Decoding looks the lengths up by control byte, sums them to places, and
gathers: no loop over tokens. Blocks are binary cells of Parquet files, so any file system that Spark reads will do;
the rank table lies beside them.

Texts are encoded once, and the ids kept compressed until all are counted; what is sorted by document is these ids.
At most one count per vocabulary entry reaches the driver.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import held_by, pieces, text_buffers, without_collector
from tidewatch.llm.remembered import Remembered

BLOCK_TOKENS = 1 << 16
PIECES_MOST = 400_000
#: new pieces that go to the library as one text
AT_ONCE = 10_000
#: bytes of texts whose words are looked up together, or one text
TEXT = 1 << 20
END_ID = 0

#: token lengths by control byte
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """``(control, data)`` of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, np.uint32)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    widest = int(lengths.max(initial=1))
    kept = np.arange(widest, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), ranks.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[:, :widest][kept].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    body = np.frombuffer(data + b"\0\0\0", np.uint8)
    starts = np.cumsum(lengths) - lengths
    out = body[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= body[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class PieceEncoder(Remembered):
    """The tokenizer file's ids of whole texts. The library cuts a text at the file's added tokens, what lies between
    into pieces by ``pattern``, and merges inside pieces only, so each distinct piece is given to it once and remembered.
    A text with an added token that takes white space or looks at its neighbours goes to the library whole."""

    def __init__(self, path: str, pattern: str, special_as_text: bool):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = sorted((t.content for t in added), key=len, reverse=True)
        self.odd = [t.content for t in added if t.single_word or t.lstrip or t.rstrip or t.normalized]
        # one token that can stand between pieces: nothing else may match there, nor the token overlap itself
        alone = self.added[0] if len(self.added) == 1 and not self.odd else None
        self.between = alone if alone and not any(alone.startswith(alone[i:]) for i in range(1, len(alone))) else None
        self.between_id = self.tokenizer.token_to_id(alone) if alone else None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split
        self.added_ids = {t: array("I", [self.tokenizer.token_to_id(t)]).tobytes() for t in self.added}
        # bytes of each id's token in a byte-level file
        self.widths = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if i < len(self.widths):
                self.widths[i] = len(token)
        if self.between:
            self.widths[self.between_id] = len(self.between.encode())
        super().__init__(pattern, self._ids, PIECES_MOST)

    @classmethod
    def of(cls, path: str, pattern: str, special_as_text: bool) -> PieceEncoder:
        key, kept = (path, pattern, special_as_text), held_by("token_files")
        if key not in kept:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            kept[key] = cls(*key)
        return kept[key]

    def parts(self, text: str) -> list[str] | None:
        """What lies between the added tokens of a text, and these at odd places; nothing for a text that the library
        must see whole."""
        if not any(t in text for t in self.added):
            return [text]
        return None if any(t in text for t in self.odd) else self.cut(text)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; as one text with the added token between the pieces, where there is such a token."""
        return [ids for i in range(0, len(pieces), AT_ONCE) for ids in self._some_ids(pieces[i:i + AT_ONCE])]

    def _some_ids(self, pieces: list[str]) -> list[bytes]:
        if self.between and not any(self.between in p for p in pieces):
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            cuts, raw = np.flatnonzero(ids == self.between_id) * 4, ids.tobytes()
            return [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def of_cut(self, heads: list[str], words: list[str]) -> list[bytes]:
        if not self.between:
            return super().of_cut(heads, words)
        items = [h + self.between for h in heads] + [" " + w for w in words]
        out = []
        for i in range(0, len(items), AT_ONCE):
            part, ended = items[i:i + AT_ONCE], max(0, min(len(heads) - i, AT_ONCE))
            found = self._run(part, ended)
            out += super().of_cut(heads[i:i + ended], [w[1:] for w in part[ended:]]) if found is None else found
        return out

    def _run(self, items: list[str], ended: int) -> list[bytes] | None:
        """The ids of each of ``items`` from one text of them all, where the library ends a token with each of them; the
        added token that the first ``ended`` end with is left out."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(items)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.widths[ids])
        due = np.cumsum(np.fromiter((len(t.encode()) for t in items), np.int64, len(items)))
        at = np.searchsorted(ends, due, "left")
        if (not len(ends) or ends[-1] != due[-1] or (ends[at] != due).any()
                or np.count_nonzero(ids == self.between_id) != ended or (ids[at[:ended]] != self.between_id).any()):
            return None
        raw, cuts = ids.tobytes(), (4 * at + 4).tolist()
        return [raw[a:b - 4 if i < ended else b] for i, (a, b) in enumerate(zip([0, *cuts], cuts))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts = [self.parts(t) for t in texts]
        ids = iter(self.of_texts([p for found in parts for p in (found or [])[::2]]))
        for text, found in zip(texts, parts):
            if found is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            elif len(found) == 1:
                yield np.frombuffer(next(ids), np.uint32)
            else:
                yield np.frombuffer(b"".join([self.added_ids[p] if i % 2 else next(ids) for i, p in enumerate(found)]), np.uint32)


def _encoded(path: str, pattern: str, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = PieceEncoder.of(path, pattern, special_as_text), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b in pieces(text_buffers(batch.column(1))[1], TEXT):
                part = batch.slice(a, b - a)
                n, cells = [], []
                with without_collector():
                    found = list(encoder.encode([t or "" for t in part.column(1).to_pylist()]))
                for ids in found:
                    ids = np.append(ids, np.uint32(END_ID))
                    n.append(len(ids))
                    small = ids.astype(np.uint16) if int(ids.max()) < 1 << 16 else ids
                    cells.append(press.compress(small.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], ["doc_id", "n", "ids"])

    return run


def _ids(cell: bytes, n: int, press: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = press.decompress(cell)
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, press = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
    for batch in batches:
        cells = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for a in range(0, len(cells), 64):
            seen = np.bincount(np.concatenate([_ids(cell, n, press) for n, cell in cells[a:a + 64]]))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[:len(seen)] += seen
    have = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], ["id", "n"])


def _blocks(rank_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, number, press = rank_of.value, 0, zstandard.ZstdDecompressor()
        docs, sizes, held, tokens = [], [], [], 0

        def block():
            control, data = pack(ranks[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["block", "doc_ids", "sizes", "control", "data"])

        for batch in batches:
            for doc_id, n, cell in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs.append(doc_id)
                sizes.append(n)
                held.append(_ids(cell, n, press))
                tokens += n
                if tokens >= BLOCK_TOKENS:
                    yield block()
                    number += 1
                    docs, sizes, held, tokens = [], [], [], 0
        if docs:
            yield block()

    return run


def _read(id_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = id_of.value
        for batch in batches:
            for part, number, docs, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = ids_by_rank[unpack(control, data, sum(sizes))].astype("<u4")
                ends = np.cumsum([0, *sizes])
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array([number] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()),
                     pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, folder: str, path: str, pattern: str, special_as_text: bool = True) -> None:
    """Encode ``docs(doc_id, text, ...)`` by the tokenizer file and write blocks and ranks below ``folder``.

    With ``special_as_text`` a special token of the file that stands in a text is read as ordinary text; without, it is its
    one id, as the library has it by default. Null texts are empty; every document ends with ``END_ID``. Rows with a null id come first; rows with the same id
    stay neighbours, in the order of their ids' bytes. An empty table writes an empty table of blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_encoded(path, pattern, special_as_text), "doc_id long, n long, ids binary").write.option("compression", "none").parquet(f"{folder}/ids")
    spark = docs.sparkSession
    ids = spark.read.parquet(f"{folder}/ids")
    counts = ids.select("n", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "id").select("id").toArrow().column(0).to_numpy()
    spark.createDataFrame([(ranked.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    (ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids")
     .mapInArrow(_blocks(spark.sparkContext.broadcast(rank_of)), "block long, doc_ids array<long>, sizes array<long>, control binary, data binary")
     .select(F.spark_partition_id().alias("part"), "*").write.option("compression", "zstd").parquet(f"{folder}/blocks"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from the files."""
    raw = spark.read.parquet(f"{folder}/ranks").first()[0]
    id_of = spark.sparkContext.broadcast(np.frombuffer(bytes(raw), "<u4"))
    rows = spark.read.parquet(f"{folder}/blocks").select("part", "block", "doc_ids", "sizes", "control", "data").mapInArrow(
        _read(id_of), "part int, block long, place long, doc_id long, n_tokens long, ids_crc32 long")
    # a running sum inside each part, which is a bounded range of ids, and one over the parts' totals
    own = Window.partitionBy("part").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    totals = (spark.read.parquet(f"{folder}/blocks").select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
              .groupBy("part").agg(F.sum("n").alias("n")))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return placed.join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares (``spark.checkpoint.dir``), or a temporary one in local tests."""
    from tidewatch.session import cut_lineage
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        cut_lineage(spark.range(1))  # makes the local session's folder, or raises on a cluster
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tokens-{uuid.uuid4().hex}"
