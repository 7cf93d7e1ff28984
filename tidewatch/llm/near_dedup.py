"""Near-duplicate classes: universal hash minima with banding, signature verification, exact confirmation on full
shingle sets, and components by large-star and small-star.

1. One Arrow pass makes per row: the number of distinct five-word shingles, a 128-bit key of the set (equal sets have
   equal keys) and ``BANDS * ROWS`` minima of universal hashes. Equal sets become one class before anything else, so
   exact copies never meet in a bucket.
2. Bucket = (band, hash of its minima), its leader the smallest id in it. First every class is compared with the smallest
   of its leaders, one pair each. Buckets whose members are then in one component are done. Members of the others go
   through an exact prefix filter on their rarest shingles. So no link is lost, and no group is expanded into all its pairs.
3. A pair is compared by signature first (``LEAST_AGREEMENT``: more than six standard deviations below the
   threshold), the rest exactly by the sizes of intersection and union.

Shingles are compared by 64-bit hash: two different ones in a pair of documents of 20,000 words are taken for equal with
probability below 1e-10. A pair at the threshold itself shares no bucket with probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bitmap import Bitmap, bitmap_of
from tidewatch.llm.common import held_by, mix64, pieces, text_buffers, windows_of, words_of
from tidewatch.llm.components import components
from tidewatch.session import cut_lineage

WORDS = 5
BANDS, ROWS = 32, 4
#: share of equal minima below which a pair can't reach 0.75: 128 minima have a standard deviation of 0.038
LEAST_AGREEMENT = 0.5

_rng = np.random.Generator(np.random.PCG64(20_240_601))
_A = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    body, offsets = text_buffers(texts)
    for a, b in pieces(offsets):
        own = offsets[a:b + 1] - offsets[a]
        _, rows, hashes = words_of(body[offsets[a]:offsets[b]], own, lower=True)
        cut = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(windows_of(hashes[cut[i]:cut[i + 1]], WORDS))


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each universal hash ``(a x + b) >> 32`` of the 32-bit folded shingle the smallest value."""
    folded = (mix64(shingles) >> np.uint64(32))
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(folded), 2048):
        block = (folded[i:i + 2048, None] * _A + _B) >> np.uint64(32)
        best = np.minimum(best, block.min(axis=0))
    return best.astype(np.uint32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_by("near_dedup")
    for batch in batches:
        n, key1, key2, signatures = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            key1.append(int(np.add.reduce(mix64(s + np.uint64(11)))) & (1 << 64) - 1)
            key2.append(int(np.add.reduce(mix64(s ^ np.uint64(0x3C6EF372FE94F82B)))) & (1 << 64) - 1)
            signatures.append(minima(s).tobytes() if len(s) else b"")
        as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_long(key1), as_long(key2),
                                          pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "key1", "key2", "signature"])


def _bands(only: Bitmap | None):
    """``(bucket, id)`` for every band of every row; with a bitmap, only for buckets that may be in it."""
    weights = mix64(np.arange(1, ROWS + 1, dtype=np.uint64))
    seeds = mix64(np.arange(101, 101 + BANDS, dtype=np.uint64))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by("near_dedup")
        for batch in batches:
            if batch.num_rows:
                all_minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
                buckets = mix64((all_minima.astype(np.uint64) * weights).sum(axis=2) + seeds).reshape(-1).view(np.int64)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                if only is not None:
                    hit = only.may_hold(buckets)
                    buckets, ids = buckets[hit], ids[hit]
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ids)], ["bucket", "id"])

    return bands


def _rows_in(only: Bitmap):
    """The rows whose first column may be in the bitmap."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(only.may_hold(batch.column(0).to_numpy(zero_copy_only=False))))

    return rows


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            near = pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT)
            yield batch.select([0, 1]).filter(near)


def _sets(only: Bitmap):
    """``(id, shingles)`` of the texts whose id may be in the bitmap."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by("near_dedup")
        for batch in batches:
            batch = batch.filter(pa.array(only.may_hold(batch.column(0).to_numpy(zero_copy_only=False))))
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                own = [s.view(np.int64) for s in shingle_sets(part.column(1))]
                ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))], ["id", "shingles"])

    return sets


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents in ``ids(id)``, checkpointed. Texts are read again, never shuffled."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    some = texts.mapInArrow(_sets(bitmap_of(ids)), "id long, shingles array<long>")
    return cut_lineage(some.join(ids, "id", "left_semi"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets reach the threshold, checkpointed."""
    pairs = cut_lineage(pairs)
    signed = reps.mapInArrow(_rows_in(bitmap_of(_ends(pairs))), "id long, signature binary")
    near = cut_lineage(pairs.join(signed.select(F.col("id").alias("v"), F.col("signature").alias("right")), "v")
                       .join(signed.select(F.col("id").alias("u"), F.col("signature").alias("left")), "u")
                       .select("u", "v", "left", "right").mapInArrow(_agree, "u long, v long"))
    sets = _full_sets(docs, _ends(near))
    common = F.size(F.array_intersect("a", "b"))
    return cut_lineage(
        near.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        .join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
        .select("u", "v", common.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
        .where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("u", "v").distinct())


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets that still hold more than one component, with their root."""
    placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    ends = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    return placed.join(ends.where("x <> y").select("bucket"), "bucket", "left_semi")


def _prefix_pairs(rest: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Every pair of ``rest(id, root)`` from two components that can reach the threshold.

    Ordered from the rarest shingle, two sets of the threshold's similarity share one of their first
    ``n - ceil(n * percent / 100) + 1``. Members of a family that differ by own edits have rare shingles there, so
    few of them meet, however many they are.
    """
    each = _full_sets(docs, rest.select("id")).select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.join(each.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1"), "shingle")
    by_id = Window.partitionBy("id", "n")
    # the shingles that only one set has come first; ``after`` counts those behind a place
    placed = shared.select("id", "n", "shingle", (F.count("*").over(by_id) - F.row_number().over(by_id.orderBy("f", "shingle"))).alias("after"))
    prefix = placed.where(F.col("after") + 1 >= F.ceil(F.col("n") * percent / 100))
    prefix = cut_lineage(prefix.join(rest, "id").select("shingle", "id", "n", "root", "after"))
    left = prefix.select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "root", "after")])
    # from its first common shingle on, a pair can share no more than what either set has left
    near = left.join(prefix, "shingle").where(
        f"id > p_id and root <> p_root and (1 + least(after, p_after)) * {100 + percent} >= {percent} * (n + p_n)")
    return near.select(F.col("p_id").alias("u"), F.col("id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set is the distinct five-word shingles, or the whole
    sequence where there are fewer words. Rows are linked when ``100 * intersection >= percent * union``.
    Null or wordless texts have an empty set and link with nothing. A null id links with nothing, has a null
    ``component_id`` and is kept. Rows that share an id are one document: a link of one holds for all. Ties go to
    the smallest id; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = cut_lineage(docs.mapInArrow(_features, "doc_id long, n_shingles long, key1 long, key2 long, signature binary"))
    filled = features.where("doc_id is not null and n_shingles > 0")
    keys = ["n_shingles", "key1", "key2"]
    classes = cut_lineage(filled.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    of_class = filled.select("doc_id", *keys).join(classes.where("n > 1"), keys)
    copies = of_class.where("doc_id <> rep")
    # one row per class; an id that occurs with several texts stands for each of its classes
    reps = filled.join(copies.select("doc_id", *keys), ["doc_id", *keys], "left_anti").select(F.col("doc_id").alias("id"), "signature")
    reps = cut_lineage(reps)
    shared = reps.mapInArrow(_bands(None), "bucket long, id long").groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("bucket", "first")
    shared = cut_lineage(shared)
    # most buckets hold one member; the bitmap keeps these from the second shuffle
    buckets = reps.mapInArrow(_bands(bitmap_of(shared.select("bucket"))), "bucket long, id long")
    members = cut_lineage(buckets.join(shared, "bucket").select("bucket", "first", "id").distinct())
    rows = members.count()
    edges = roots = None
    if rows:
        # one pair per member first: with the smallest leader of all its buckets
        least = members.where("id <> first").groupBy("id").agg(F.min("first").alias("u")).select("u", F.col("id").alias("v"))
        edges = _confirmed(least, reps, docs, percent)
        roots = components(edges)
        rest = cut_lineage(_mixed(members, roots).select("id", "root").distinct())
        found = _confirmed(_prefix_pairs(rest, docs, percent), reps, docs, percent)
        if found.count():
            edges = cut_lineage(edges.union(found))
    links = copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    roots = components(links.union(edges) if rows else links)
    out = features.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; the columns stay as they are."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
