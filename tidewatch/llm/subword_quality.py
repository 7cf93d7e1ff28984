"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, with a softmax on top.

A *unit* of a text is a word or an n-gram of ``ORDERS`` bytes inside a word and its edges (a space before or behind counts), hashed into
``BUCKETS`` with a vector of ``DIMENSIONS`` each. A text is the mean of its units' vectors; vectors and softmax are learned together by
stochastic gradient descent in numpy. The case of letters is kept, digits are one letter. Since the softmax is linear in the mean, a
trained model is one number per bucket (the log-odds of label 1), and a text's score is one gather and one sum over its bytes,
whatever its length; a logistic curve fitted on a held-back fifth of the sample, at the corpus' own label rates, calibrates it.

The fit takes a bounded sample: of the usable labelled texts (equal texts with one label count once) about ``PER_LABEL`` of each
label, drawn by a hash of the text, or fewer where their units would exceed ``SAMPLE_BYTES``. Texts are drawn by a narrow table of
hashes; only units and counts of the sample reach the driver. Everything else covers every row and whole texts.

Defined results: a null or empty text has no units and scores what the curve gives without evidence; without usable labels of
both kinds every text scores the share of label 1 (one half without any). A document with both labels counts with both. Labels other than 0
and 1 and rows without an id are not learned from. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold_of, pieces, run_hashes, text_buffers

#: buckets of words, and as many of n-grams
HALF = 1 << 14
BUCKETS = 2 * HALF
ORDERS = (3, 4, 5)
DIMENSIONS = 16
PER_LABEL = 3000
SAMPLE_BYTES = 64 << 20
EPOCHS, RATE, BATCH = 12, 120.0, 64

_UNIT = np.arange(256, dtype=np.uint8)
_UNIT[48:58] = 48
_UNIT[[0x20, *range(0x09, 0x0E)]] = 0x20
_SPACE = 0x20


@dataclass
class Model:
    weights: np.ndarray  # log-odds of label 1 per bucket, and 0 for what is no unit
    slope: float = 1.0
    bias: float = 0.0

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.bias, -30, 30)))


def units(body: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For words and each order, the bucket of the unit that begins at each byte; ``BUCKETS`` where none does."""
    n = len(body)
    edge = body == _SPACE
    starts, _, hashes, _ = run_hashes(body, ~edge, offsets)
    out = np.full(n, BUCKETS, np.int32)
    out[starts] = (hashes & np.uint64(HALF - 1)).astype(np.int32)
    yield out
    for order in ORDERS:
        h = np.full(n, 0x51ED + order, np.uint32)
        whole = np.ones(n, bool)
        for j in range(order):
            left = max(0, n - j)
            h[:left] = (h[:left] ^ body[j:]) * np.uint32(0x01000193)
            whole[left:] = False
            if 0 < j < order - 1:
                whole[:left] &= ~edge[j:]
            if j:
                last = offsets[1:] - j
                whole[last[last >= offsets[:-1]]] = False
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - HALF.bit_length() + 1)
        yield np.where(whole, h.astype(np.int32) + HALF, BUCKETS)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    body, offsets = text_buffers(column)
    for a, b in pieces(offsets):
        yield _UNIT[body[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]


def mean_weights(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each text's units; 0 where there is none."""
    out = [np.zeros(0)]
    for body, offsets in _texts(column):
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            at = offsets[:-1][filled]
            for own in units(body, offsets):
                total[filled] += np.add.reduceat(weights[own], at, dtype=np.float64)
                count[filled] += np.add.reduceat(own < BUCKETS, at, dtype=np.int64)
        out.append(total / np.maximum(1, count))
    return np.concatenate(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, label, text)`` -> ``(key, label, buckets, counts)``."""
    for batch in batches:
        where, number = [], []
        for body, offsets in _texts(batch.column(2)):
            found = list(units(body, offsets))
            for i in range(len(offsets) - 1):
                seen = sum(np.bincount(u[offsets[i]:offsets[i + 1]], minlength=BUCKETS + 1) for u in found)[:BUCKETS]
                where.append(np.flatnonzero(seen).astype(np.uint16).tobytes())
                number.append(np.minimum(seen[seen > 0], 65535).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(where, pa.binary()), pa.array(number, pa.binary())],
                                         ["key", "label", "buckets", "counts"])


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> tuple[DataFrame, dict[int, int]]:
    """``(key, label, text)`` of the drawn texts, and how many different texts each label has."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(usable).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").where(usable)
    own = own.withColumn("key", F.xxhash64("text"))
    # hashes only: equal rows of a document collapse before they travel
    narrow = own.select("doc_id", "key", F.octet_length("text").alias("size")).distinct()
    pool = narrow.join(marks, "doc_id").groupBy("key", "label").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    # a text ships at most 4 bytes for each unit, and for each bucket
    cost = F.least(F.col("size").cast("long") * (1 + len(ORDERS)), F.lit(BUCKETS)) * 4
    draw = F.xxhash64("key", F.lit(13)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    pool = pool.select("key", "label", "doc_id", cost.alias("cost"), draw.alias("draw"))
    totals = {r.label: (r.n, r.cost) for r in pool.groupBy("label").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()}
    share = F.lit(0.0)
    for y, (n, total) in totals.items():
        share = F.when(F.col("label") == y, min(1.0, PER_LABEL / n, SAMPLE_BYTES / 2 / max(1, total))).otherwise(share)
    chosen = pool.where(F.col("draw") < share).select("key", "label", "doc_id")
    rows = own.join(F.broadcast(chosen), ["key", "doc_id"]).select("key", "label", "text").dropDuplicates(["key", "label"])
    return rows, {y: n for y, (n, _) in totals.items()}


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (where, number) in enumerate(rows):
        x[i, where] = number / max(1.0, number.sum())
    return x


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Log-odds per bucket from ``(buckets, counts)`` per text and its label, both labels weighing the same."""
    rng = np.random.Generator(np.random.PCG64(13))
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    balance = (len(y) / 2 / np.maximum(1, np.bincount(y, minlength=2))).astype(np.float32)
    for epoch in range(EPOCHS):
        order, step = rng.permutation(len(y)), RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            own = order[a:a + BATCH]
            x = _dense([rows[i] for i in own])
            touched = np.flatnonzero(x.any(axis=0))
            x = x[:, touched]
            hidden = x @ embed[touched]
            z = hidden @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= (balance[y[own]] / len(own))[:, None]
            down = x.T @ (p @ out.T)
            out -= step * 0.01 * (hidden.T @ p)
            embed[touched] -= step * down
    return (embed @ (out[:, 1] - out[:, 0])).astype(np.float64)


def _curve(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias of the logistic curve through weighted points, by Newton's method with a small ridge."""
    scale = max(float(np.abs(z).max()), 1e-9)
    design, beta = np.stack([z / scale, np.ones(len(z))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - np.array([0.01, 0.0]) * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6])
        step = np.clip(np.linalg.solve(hessian, gradient), -4, 4)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]) / scale, 0.0), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> Model:
    """The model; the same rows give the same model, whatever their order."""
    chosen, totals = sample(docs, labels, label, usable)
    rows = chosen.mapInArrow(_counted, "key long, label int, buckets binary, counts binary").toPandas().sort_values(["key", "label"], ignore_index=True)
    examples = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(c, np.uint16).astype(np.float32)) for b, c in zip(rows["buckets"], rows["counts"])]
    y = rows["label"].to_numpy(np.int64)
    if len(set(y)) < 2:
        n, positive = sum(totals.values()), totals.get(1, 0)
        return Model(np.zeros(BUCKETS + 1), 0.0, float(np.log((positive + 0.5) / (n - positive + 0.5))))
    held = rows["key"].to_numpy() % 5 == 0
    if min(np.bincount(y[held], minlength=2).min(), np.bincount(y[~held], minlength=2).min()) == 0:
        held[:] = True
        fit = held
    else:
        fit = ~held
    weights = learn([examples[i] for i in np.flatnonzero(fit)], y[fit])
    z = np.array([float(weights[b] @ c) / max(1.0, float(c.sum())) for b, c in examples])
    share = np.array([totals.get(k, 0) / max(1, (y[held] == k).sum()) for k in (0, 1)])
    w = share[y[held]] * held.sum() / sum(totals.values())
    slope, bias = _curve(z[held], y[held], w)
    return Model(np.concatenate([weights, [0.0]]), slope, bias)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the probability of label 1 as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.probability(mean_weights(pa.array(texts, pa.large_string(), from_pandas=True), m.weights)))

    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col("text").cast("string")))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; rows whose crc32 of the id modulo ``folds`` is ``held`` are not learned from."""
    out = fold_of(F.col("doc_id"), folds) == held
    model = train(docs, labels, label, ~out)
    rows = with_score(docs.select("doc_id", "text"), model, "score")
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
