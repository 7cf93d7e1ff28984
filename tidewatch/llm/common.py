"""Shared by the operators here: session settings, tables, free column names, and words of a text batch in numpy."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import prepare

#: rows per Arrow batch; with texts of 100 KB that is 25 MB, so a Python worker stays small
BATCH_ROWS = 256
#: bytes of text that the numpy passes below take at a time (a longer single text is taken whole)
PIECE_BYTES = 1 << 21


def session(spark: SparkSession) -> SparkSession:
    """Settings for text in Arrow batches, and the package shipped to the Python workers."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


_held: dict[str, dict] = {}


def held_by(owner: str) -> dict:
    """What ``owner``'s code keeps in this worker process from batch to batch.

    What other owners kept is dropped: a worker that serves one stage after another holds the caches of one.
    Memory that earlier stages freed goes back to the system then, not only to this process.
    """
    if owner not in _held:
        _held.clear()
        _powers.clear()
        _give_back()
        _held[owner] = {}
    return _held[owner]


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def without_collector():
    """Many objects without cycles are made inside; the collector would walk all that are kept again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and doubled as longer texts come."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null text is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES):
    """Row ranges of up to ``most`` bytes (or one row)."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, rows)
        start = min(stop, rows)


def run_hashes(body: np.ndarray, inside: np.ndarray, offsets: np.ndarray, first: int = 0):
    """Runs of bytes where ``inside`` holds, cut at row ends: ``(starts, rows, hashes)``.

    The 64-bit hash depends on the bytes alone. With ``first``, also the hash of each run's first bytes.
    """
    n = len(body)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return starts, starts, none, none
    rows = np.searchsorted(offsets, starts, "right") - 1
    value = np.where(inside, body.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _power("p", _P, n)
    back = _power("q", _P_INVERSE, n)[starts]
    hashes = mix64(np.add.reduceat(value, starts) * back)
    if not first:
        return starts, rows, hashes, None
    run = np.cumsum(begins) - 1
    value[(np.arange(n) - starts[np.maximum(run, 0)]) >= first] = 0
    return starts, rows, hashes, mix64(np.add.reduceat(value, starts) * back ^ np.uint64(0x5555))


def words_of(body: np.ndarray, offsets: np.ndarray, lower: bool):
    """Words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased on demand) as ``(starts, rows, hashes)``."""
    body = _LOWER[body] if lower else body
    starts, rows, hashes, _ = run_hashes(body, ~_SPACE[body], offsets)
    return starts, rows, hashes


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` words in a row (the whole sequence where there are fewer)."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    count = len(hashes) - size + 1
    total = np.full(count, size * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
    factor = 1
    for j in range(size):
        factor = (factor * 0xA0761D6478BD642F + 2 * j) % (1 << 64) | 1
        total += hashes[j:j + count] * np.uint64(factor)
    return mix64(total)
