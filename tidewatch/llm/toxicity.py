"""Toxicity by maximum-scoring segments: log-odds of tokens with Dirichlet priors, a linear scan for all maximal
segments, and extreme-value statistics over them.

*Tokens* are runs of ASCII letters and digits or bytes above 127, lower-cased. *Scores*: the log-odds of a token in toxic
against clean training texts, where the prior of the counts of a token, and of its stem (first ``STEM`` bytes), is the
overall rate; each text counts a token once, and equal texts count once. Scores below ``Z`` standard deviations are replaced by
the stem's, or by a small negative drift, so that a random text's segments stay short.

*Segments*: the linear-time scan of Ruzzo and Tompa keeps every maximal segment. A segment of score ``s`` in ``n`` tokens
has the expected number ``E = K n exp(-lambda s)`` in clean text; ``lambda`` solves ``sum p exp(lambda s) = 1`` over the clean tokens
and ``K`` is the mean of clean maxima. A document's evidence is the sum of ``-ln E`` over segments with ``E < 1``; a
logistic curve fitted on the training texts turns it into the score.

Counts are hashed into ``WORDS`` + ``STEMS`` buckets and summed over a bounded sample of labelled rows; the tables and the histogram of
evidence, all of bounded size, are what reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold_of, pieces, run_hashes, text_buffers
from tidewatch.session import cut_lineage

WORDS, STEMS, STEM = 1 << 20, 1 << 16, 4
PRIOR, Z, DRIFT, TOP = 4.0, 3.0, -0.25, 8.0
#: labelled rows that the model is fitted on, at most (in expectation)
SAMPLE = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(word buckets, stem buckets)`` of each text, in order."""
    body, offsets = text_buffers(texts)
    for a, b in pieces(offsets):
        own, part = offsets[a:b + 1] - offsets[a], _LOWER[body[offsets[a]:offsets[b]]]
        _, rows, words, stems = run_hashes(part, _TOKEN[part], own, first=STEM)
        if stems is None:
            stems = words
        words, stems = (words & np.uint64(WORDS - 1)).astype(np.int64), (stems & np.uint64(STEMS - 1)).astype(np.int64)
        cut = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            yield words[cut[i]:cut[i + 1]], stems[cut[i]:cut[i + 1]]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, end exclusive, in linear time.

    Only positive places open a segment; runs between them are taken from prefix sums. On the stack, each candidate
    knows the sums before and after it and the nearest one that starts lower; a new one is joined with the nearest candidate that starts lower, if it ends higher.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = at, at + 1, float(sums[at]), float(sums[at + 1])
        j = len(stack) - 1
        while True:
            # those passed over start no lower than the one they are reached from
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low, lower = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = lower
    return [(a, b, h - lo) for a, b, lo, h, _ in stack]


@dataclass
class Model:
    word: np.ndarray
    stem: np.ndarray
    rate: float = 1.0       # lambda
    scale: float = 1.0      # K
    slope: float = 0.0
    bias: float = -4.0

    def scores(self, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        own, root = self.word[words], self.stem[stems]
        return np.where(own != 0, own, np.where(root != 0, root, np.float32(DRIFT)))

    def segments(self, words: np.ndarray, stems: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant passages ``(first token, end, -ln E)``."""
        found = maximal_segments(self.scores(words, stems))
        base = math.log(max(self.scale * max(len(words), 1), 1e-9))
        return [(a, b, self.rate * s - base) for a, b, s in found if self.rate * s > base]

    def evidence(self, words: np.ndarray, stems: np.ndarray) -> float:
        return sum(e for _, _, e in self.segments(words, stems))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(evidence, 60.0) + self.bias, -30, 30)))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(kind, bucket, toxic, n)``: texts of the partition that hold a bucket; kind 0 word, 1 stem, 2 all texts."""
    for batch in batches:
        labels = batch.column(1).to_numpy()
        found: list[list[np.ndarray]] = [[], [], [], []]
        for (words, stems), y in zip(tokens_of(batch.column(0)), labels):
            found[y].append(np.unique(words))
            found[2 + y].append(np.unique(stems))
        kinds, buckets, toxic, numbers = [], [], [], []
        for which, lists in enumerate(found):
            if lists:
                b, n = np.unique(np.concatenate(lists), return_counts=True)
                buckets.append(b)
                numbers.append(n)
                kinds.append(np.full(len(b), which // 2))
                toxic.append(np.full(len(b), which % 2))
        for y in (0, 1):
            buckets.append(np.zeros(1, np.int64))
            numbers.append(np.array([(labels == y).sum()]))
            kinds.append(np.array([2]))
            toxic.append(np.array([y]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (kinds, buckets, toxic, numbers)], ["kind", "bucket", "toxic", "n"])


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and its z-score with a Dirichlet prior of weight ``PRIOR`` split by ``rate``."""
    t, c = toxic + PRIOR * rate, clean + PRIOR * (1 - rate)
    odds = np.log(t / (n_toxic + PRIOR)) - np.log(c / (n_clean + PRIOR))
    return odds, odds / np.sqrt(1 / t + 1 / c)


def _tables(rows) -> tuple[np.ndarray, np.ndarray]:
    kind, bucket, toxic, n = (rows.column(i).to_numpy() for i in range(4))

    def grid(which: int, size: int) -> np.ndarray:
        out = np.zeros((2, size))
        own = kind == which
        out[toxic[own], bucket[own]] = n[own]
        return out

    clean_texts, toxic_texts = grid(2, 1)[:, 0]
    overall = min(max(toxic_texts / max(toxic_texts + clean_texts, 1), 0.01), 0.99)
    stems, words = grid(1, STEMS), grid(0, WORDS)
    odds, z = _log_odds(stems[1], stems[0], toxic_texts, clean_texts, np.full(STEMS, overall))
    stem = np.where(z >= Z + 1, np.minimum(odds, TOP), 0.0)
    odds, z = _log_odds(words[1], words[0], toxic_texts, clean_texts, np.full(WORDS, overall))
    seen = words.sum(axis=0) > 0
    word = np.where(seen & (z >= Z), np.minimum(odds, TOP), np.where(seen & (z <= -Z), np.maximum(odds, -1.0), 0.0))
    return word.astype(np.float32), stem.astype(np.float32)


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of ``sum p exp(rate * s) = 1``; 1 where no score is positive."""
    p = weights / weights.sum() if weights.sum() else weights
    if not (values[weights > 0] > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return max(low, 0.05)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, toxic)`` of a bounded sample of the training rows, checkpointed: labelled 0 or 1, with text, crc32 of the id
    not divisible by 5. Above ``SAMPLE`` labels, those with the smallest hashes of the id are drawn, about ``SAMPLE`` of them, so
    the labels can be broadcast and no text is shuffled. Equal texts with one label count once.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(fold_of(F.col("doc_id")) != 0).distinct()
    total = marks.count()
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)).cast("double") * total < float(SAMPLE << 20))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = cut_lineage(own.join(F.broadcast(drawn), "doc_id").withColumn("key", F.xxhash64("text")))
    first = rows.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(F.broadcast(first), ["key", "toxic", "doc_id"]).select("text", "toxic")


def _spread(model):
    """Histograms over training texts: kind 0 clean tokens by score, 1 clean maxima (rate * max - ln n), 2 evidence by label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        tally: dict[tuple[int, int, int], int] = {}

        def add(kind, value, y, n=1):
            key = (kind, int(round(value * 20)), y)
            tally[key] = tally.get(key, 0) + n

        for batch in batches:
            for (words, stems), y in zip(tokens_of(batch.column(0)), batch.column(1).to_pylist()):
                s = m.scores(words, stems)
                if y == 0 and m.slope == 0 and m.scale == 1.0:
                    values, n = np.unique(np.round(s * 20), return_counts=True)
                    for v, k in zip(values, n):
                        add(0, v / 20, 0, int(k))
                best = max((x for _, _, x in maximal_segments(s)), default=0.0)
                if y == 0 and len(s):
                    add(1, math.exp(min(20.0, m.rate * best)) / len(s) if best else 0.0, 0)
                add(2, min(60.0, m.evidence(words, stems)), y)
        keys = list(tally)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array([tally[k] for k in keys], pa.int64())], ["kind", "value", "toxic", "n"])

    return run


def _histogram(rows: DataFrame, model: Model) -> pd.DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_spread(shared), "kind long, value long, toxic long, n long").groupBy("kind", "value", "toxic").agg(F.sum("n").alias("n"))
    return out.orderBy("kind", "value", "toxic").toPandas()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model. Without labelled rows, or with one label only, every text scores below one half."""
    rows = labelled(docs, labels)
    counts = rows.mapInArrow(_presence, "kind long, bucket long, toxic long, n long").groupBy("kind", "bucket", "toxic").agg(F.sum("n").alias("n"))
    # a bucket that one text holds can't be significant: it needn't travel
    model = Model(*_tables(counts.where("n > 1 or kind = 2").toArrow()))
    first = _histogram(rows, model)
    tokens = first[first["kind"] == 0]
    model.rate = _rate(tokens["value"].to_numpy() / 20, tokens["n"].to_numpy().astype(float))
    # K: the mean of exp(rate * max) / n over clean texts would be heavy-tailed; its median is matched to the Gumbel median
    model.scale = 0.5
    second = _histogram(rows, model)
    maxima = second[second["kind"] == 1]
    if len(maxima):
        cum = maxima["n"].cumsum().to_numpy()
        median = maxima["value"].to_numpy()[np.searchsorted(cum, cum[-1] / 2)] / 20
        model.scale = min(max(median * math.log(2), 0.01), 10.0)
        second = _histogram(rows, model)
    curve = second[second["kind"] == 2]
    x, y, n = curve["value"].to_numpy() / 20, curve["toxic"].to_numpy(), curve["n"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return model
    w = np.array([-3.0, 0.3])
    design = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.01 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(w[0]), float(max(w[1], 1e-3))
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_passages)`` for every row of ``docs``; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(texts: pd.Series) -> pd.DataFrame:
        m: Model = shared.value
        found = [m.segments(w, s) for w, s in tokens_of(pa.array(texts, pa.large_string(), from_pandas=True))]
        evidence = np.array([sum(e for _, _, e in f) for f in found], float)
        return pd.DataFrame({"score": m.probability(evidence), "n_passages": [len(f) for f in found]})

    out = F.pandas_udf(score, "score double, n_passages long")(F.col("text").cast("string"))
    rows = docs.select("doc_id", "text").select("doc_id", out.alias("s"))
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("s.score").alias("score"),
                       (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.n_passages").alias("n_passages"))
