"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks.

The ratio is compressed by raw bytes. Repetitive text has a low one, text without structure a high one; how low and
how high depends on length, since short texts have no history to refer to. A document fails where its ratio leaves the band of its length,
or where too many of its chunks leave the chunks' band, which finds long documents that are bad in part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidewatch.llm.common import pieces, text_buffers, windows_of, words_of

LEVEL = 3
#: fixed limits: from this many bytes on, the ratio must lie between the two
BANDS = ((0, 0.0, 9.0), (512, 0.12, 0.85), (1024, 0.15, 0.80), (2048, 0.15, 0.75), (8192, 0.12, 0.70), (32768, 0.08, 0.68))
CHUNK = 2048
CHUNK_BAND = (0.10, 0.80)
#: share of a document's whole chunks that may leave the chunks' band
BAD_CHUNKS = 0.5
REPEAT = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"
RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def ratio(raw: bytes, press: zstandard.ZstdCompressor) -> float:
    return len(press.compress(raw)) / len(raw) if raw else 1.0


def in_band(raw_size: int, value: float) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(BANDS) if raw_size >= least)
    return low <= value <= high


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of ``REPEAT`` words found twice or more (its first occurrence included)."""
    if len(hashes) <= REPEAT:
        return 0
    windows = windows_of(hashes, REPEAT)
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[back] > 1)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + REPEAT, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        body, offsets = text_buffers(batch.column(1))
        out = []
        for a, b in pieces(offsets):
            own = offsets[a:b + 1] - offsets[a]
            part = body[offsets[a]:offsets[b]]
            _, rows, hashes = words_of(part, own, lower=False)
            cut = np.searchsorted(rows, np.arange(b - a + 1))
            for i in range(b - a):
                text = part[own[i]:own[i + 1]]
                raw = text.tobytes()
                n = int(cut[i + 1] - cut[i])
                # code points in words: bytes that neither go on a character nor are white space
                chars = int(((text & 0xC0) != 0x80).sum()) - sum(map(raw.count, map(bytes, zip(_BLANK))))
                seen, again = set(), 0
                for line in raw.split(b"\n"):
                    if line.strip(_BLANK):
                        again += line in seen
                        seen.add(line)
                repeats = repeated_words(hashes[cut[i]:cut[i + 1]])
                failed = n < 20 or 100 * repeats > 30 * n
                whole = ratio(raw, press)
                chunks = [ratio(raw[c:c + CHUNK], press) for c in range(0, len(raw) - CHUNK + 1, CHUNK)]
                bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
                kept = not failed and in_band(len(raw), whole) and bad <= BAD_CHUNKS * len(chunks)
                out.append((n, chars, int(_SYMBOL[text].sum()), again, repeats, failed, kept, whole, len(chunks), bad))
        columns = list(zip(*out)) if out else [[]] * 10
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        names = [x.split()[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with the columns of ``RESULT``.

    A null or empty text has no words, fails the base rule (fewer than 20 words) and has ratio 1; other columns are
    ignored; an empty table gives an empty result. Lines and windows are compared exactly (windows by 64-bit hash).
    """
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_judged, RESULT)
