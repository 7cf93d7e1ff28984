"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its byte n-grams (A-Z lower-cased, everything that is no letter as a
space), hashed into ``BUCKETS``. The softmax is linear, so ``embedding @ weights`` is one table of ``BUCKETS`` x
languages and a text's logits are the mean of its n-grams' rows: one pass over the whole text, whatever its length.

The fit uses a bounded sample: at most ``LANGUAGES`` languages (the most frequent) and about ``PER_LANGUAGE`` documents
of each, drawn by a hash of the id. The tasks count the sample's n-grams; the driver sees only these counts.
A fifth of the sample sets the temperature and the rejection threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold_of, free_name, held_by, pieces, text_buffers

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
DIMENSIONS = 16
LANGUAGES = 256
PER_LANGUAGE = 1200
#: share of clean validation texts that rejection may cost
REJECTED = 0.001
UNKNOWN = "und"
RESULT = "struct<lang_pred:string,score:double,rejected:boolean>"

_LETTER = np.full(256, 0x20, np.uint8)
for _c in range(26):
    _LETTER[65 + _c] = _LETTER[97 + _c] = 97 + _c
_LETTER[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS + 1 rows; the last, of zeros, is for n-grams that cross a text's end
    temperature: float
    threshold: float


def buckets_of(body: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte; ``BUCKETS`` where it would cross the text's end."""
    n = len(body)
    h = np.full(n, 0x9E37 + order, np.uint32)
    for j in range(order):
        h[:n - j] = (h[:n - j] ^ body[j:]) * np.uint32(0x01000193)
    out = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    for j in range(1, order):
        last = offsets[1:] - j
        out[last[last >= offsets[:-1]]] = BUCKETS
    return out


def _letters(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    body, offsets = text_buffers(texts)
    for a, b in pieces(offsets):
        yield _LETTER[body[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_by("langid")
    for batch in batches:
        where, number = [], []
        for body, offsets in _letters(batch.column(1)):
            grams = [buckets_of(body, offsets, order) for order in ORDERS]
            for i in range(len(offsets) - 1):
                seen = sum(np.bincount(g[offsets[i]:offsets[i + 1]], minlength=BUCKETS + 1) for g in grams)[:BUCKETS]
                where.append(np.flatnonzero(seen).astype(np.int32))
                number.append(seen[where[-1]].astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(where, pa.list_(pa.int32())), pa.array(number, pa.list_(pa.float32())), batch.column(2)],
                                         ["lang", "buckets", "counts", "part"])


def training_sample(docs: DataFrame, usable: Column) -> DataFrame:
    """A bounded sample of the rows with text, language and id: ``(lang, text, part)``, part 0-4 by a hash of the id."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        (F.xxhash64(F.col("doc_id"), F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("draw"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(5)).cast("int").alias("part"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    return (rows.join(F.broadcast(sizes), "lang").where(F.col("draw") * F.col("count") < PER_LANGUAGE)
            .select("lang", "text", "part"))


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (where, number) in enumerate(rows):
        x[i, where] = number / max(1.0, number.sum())
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, usable: Column, epochs: int = 8, rate: float = 60.0, batch: int = 64) -> Model | None:
    """The model; None where no row can be learned from. The same rows give the same model, whatever their order."""
    rows = training_sample(docs, usable).select("lang", "text", "part").mapInArrow(
        _counts, "lang string, buckets array<int>, counts array<float>, part int").toPandas()
    if rows.empty:
        return None
    examples = [(np.asarray(w, np.int32), np.asarray(c, np.float32)) for w, c in zip(rows["buckets"], rows["counts"])]
    digest = [(lang, len(w), float(c.sum()), w.tobytes(), c.tobytes()) for lang, (w, c) in zip(rows["lang"], examples)]
    order = sorted(range(len(digest)), key=digest.__getitem__)
    examples, names, part = [examples[i] for i in order], [rows["lang"][i] for i in order], rows["part"].to_numpy()[order]
    languages = sorted(set(names))
    y = np.array([languages.index(x) for x in names])
    rng = np.random.Generator(np.random.PCG64(11))
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    fit, held = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    if not len(fit) or not len(held):
        fit = held = np.arange(len(y))
    balance = len(fit) / np.maximum(1, np.bincount(y[fit], minlength=len(languages))) / len(languages)
    for epoch in range(epochs):
        shuffled = rng.permutation(fit)
        step = rate * (1 - epoch / epochs)
        for a in range(0, len(shuffled), batch):
            own = shuffled[a:a + batch]
            x = _dense([examples[i] for i in own])
            hidden = x @ embed
            slope = _softmax(hidden @ weights)
            slope[np.arange(len(own)), y[own]] -= 1
            slope *= (balance[y[own]] / len(own))[:, None]
            down = x.T @ (slope @ weights.T)
            weights -= step * 0.1 * (hidden.T @ slope)
            embed -= step * down
    full = np.concatenate([embed @ weights, np.zeros((1, len(languages)), np.float32)])
    z = np.concatenate([_dense([examples[i] for i in held[a:a + 256]]) @ full[:-1] for a in range(0, len(held), 256)])
    scales = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in scales]
    temperature = float(scales[int(np.argmin(losses))])
    # a text is rejected below half the probability, or lower where that would cost clean texts
    threshold = min(0.5, float(np.quantile(_softmax(z / temperature).max(axis=1), REJECTED)) * 0.9)
    return Model(languages, full.astype(np.float32), temperature, threshold)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def classify(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``(best language, its probability)`` per text."""
    best, score = [], []
    for body, offsets in _letters(texts):
        total = np.zeros((len(offsets) - 1, len(model.languages)), np.float64)
        size = np.maximum(0, np.diff(offsets))
        filled = np.flatnonzero(size)
        if len(filled):
            for order in ORDERS:
                total[filled] += np.add.reduceat(model.table[buckets_of(body, offsets, order)], offsets[:-1][filled], axis=0, dtype=np.float64)
        grams = sum(np.maximum(0, size - order + 1) for order in ORDERS)
        p = _softmax(total / np.maximum(1, grams)[:, None] / model.temperature)
        best.append(p.argmax(axis=1))
        score.append(p.max(axis=1))
    return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def with_language(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: predicted language, calibrated probability, and whether it is rejected.

    Null texts and texts without a letter are ``und`` with score 0, and rejected; so is every text without a model.
    """
    if model is None:
        return docs.withColumn(name, F.lit(None).cast(RESULT)).withColumn(name, F.struct(
            F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        held_by("langid")
        m = shared.value
        best, score = classify(pa.array(texts, pa.large_string(), from_pandas=True), m)
        lettered = np.array([_has_letter(t) for t in texts], bool)
        names = np.array(m.languages, object)[best] if len(best) else np.zeros(0, object)
        score = np.where(lettered, score, 0.0)
        return pd.DataFrame({"lang_pred": np.where(lettered, names, UNKNOWN), "score": score, "rejected": ~lettered | (score < m.threshold)})

    return docs.withColumn(name, F.pandas_udf(predict, RESULT)(F.col("text").cast("string")))


def not_held_out() -> Column:
    """Rows that a model may be fitted on: crc32 of the id as text is not divisible by 5."""
    return F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0)


def predicted(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row of ``docs(doc_id, text, lang, ...)``."""
    model = train(docs, not_held_out())
    own = with_language(docs.select("doc_id", "text"), model, "found")
    return own.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "found.*")


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected; the columns stay as they are."""
    name = free_name(docs, "language")
    found = with_language(docs, train(docs, not_held_out()), name)
    return found.where(~F.col(name)["rejected"]).drop(name)
