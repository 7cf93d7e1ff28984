import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewatch.llm import subword_quality as sq


def corpus(n, seed=1):
    rng, rows, marks = random.Random(seed), [], []
    good, bad = ["th", "er", "ing", "on", "re", "a"], ["$$$", "xq", "zz", "###", "wv", "!!"]
    for i in range(n):
        y = rng.random() < 0.8
        words = ["".join(rng.choice(good if y or rng.random() < 0.6 else bad) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 80))]
        rows.append((i, " ".join(words)))
        marks.append((i, int(y), 0))
    return rows, marks


def labels_of(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("size", F.lit(1))


def test_held_out_accuracy_and_determinism(spark, make_docs):
    rows, marks = corpus(900)
    docs, labels = make_docs(rows), labels_of(spark, marks)
    got = {r.doc_id: r for r in sq.scored(docs, labels).collect()}
    truth = {i: y for i, y, _ in marks}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == 900 and 200 < len(held) < 400
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert np.mean([got[i].score for i in held]) == pytest.approx(np.mean([truth[i] for i in held]), abs=0.06)  # calibrated
    again = sq.scored(docs.orderBy(F.desc("doc_id")).repartition(3), labels.repartition(5)).collect()
    assert all(abs(got[r.doc_id].score - r.score) < 1e-9 for r in again)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, make_docs):
    rows, marks = corpus(300, 2)
    docs = make_docs(rows)
    fold = {r.doc_id for r in sq.scored(docs, labels_of(spark, marks)).where("held_out").collect()}
    wrong = [(i, 1 - y if i in fold else y, 1) for i, y, _ in marks]
    a = {r.doc_id: r.score for r in sq.scored(docs, labels_of(spark, marks)).collect()}
    b = {r.doc_id: r.score for r in sq.scored(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.col("doc_id").cast("string")), labels_of(spark, wrong)).collect()}
    assert a == b


def plain_mean(text, weights):
    """Units by their definition, one at a time."""
    body = "".join("0" if c in "0123456789" else " " if c in " \t\n\v\f\r" else c for c in text).encode()
    found = []
    for m in re.finditer(rb"[^ ]+", body):
        own = np.frombuffer(m.group(), np.uint8)
        found.append(next(sq.units(own, np.array([0, len(own)])))[0])
    for number, order in enumerate(sq.ORDERS):
        for i in range(len(body) - order + 1):
            gram = body[i:i + order]
            if b" " not in gram[1:-1]:
                own = np.frombuffer(gram, np.uint8)
                found.append(list(sq.units(own, np.array([0, order])))[number + 1][0])
    assert all(b < sq.BUCKETS for b in found)
    return np.mean(weights[found]) if found else 0.0


def test_mean_weights_equal_a_plain_average():
    rng = np.random.default_rng(0)
    weights = np.concatenate([rng.normal(size=sq.BUCKETS), [0.0]])
    texts = ["Abc def 12", "a", "", None, "  x  ", "ñandú\tZ 9\n8", "q" * 50, "a b c d", " lead", "trail ", "\U0001f600 ok"]
    got = sq.mean_weights(pa.array(texts), weights)
    for text, value in zip(texts, got):
        assert value == pytest.approx(plain_mean(text or "", weights), abs=1e-12), text


def test_training_is_descent_of_the_loss():
    """Steps of the written-out gradient lead to the sign a count of units would give."""
    rows = [(np.array([0, 5]), np.array([1.0, 1.0], np.float32))] * 40 + [(np.array([1, 5]), np.array([1.0, 1.0], np.float32))] * 10
    weights = sq.learn(rows, np.array([1] * 40 + [0] * 10))
    assert weights[0] > 1 and weights[1] < -1 and abs(weights[5]) < weights[0]


def test_odd_rows_and_labels(spark, make_docs):
    rows, marks = corpus(300, 3)
    full = [(i + 100, t) for i, t in rows] + ODD + [(5000, "word " * 400_000)]
    marks = [(i + 100, y, t) for i, y, t in marks] + [(6, 0, 0), (7, 1, 0), (None, 1, 0), (100, 7, 0), (101, None, 0), (102, 0, 0), (102, 1, 0), (99_999, 1, 1)]
    got = sq.scored(make_docs(full), labels_of(spark, marks)).collect()
    assert len(got) == len(full) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(set(empty.values())) == 1
    assert sq.scored(make_docs([]), labels_of(spark, [])).count() == 0
    # no labels, one label
    assert {r.score for r in sq.scored(make_docs(rows[:5]), labels_of(spark, [])).collect()} == {0.5}
    one = sq.scored(make_docs(rows), labels_of(spark, [(i, 1, 0) for i, _ in rows])).collect()
    assert all(r.score > 0.9 for r in one)


def test_the_sample_is_bounded_and_takes_each_text_once(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sq, "PER_LABEL", 100)
    rows = [(i, f"text number {i % 2000}") for i in range(4000)]
    drawn, totals = sq.sample(make_docs(rows), labels_of(spark, [(i, int(i % 2000 < 1500), 0) for i, _ in rows]), "quality", F.lit(True))
    got = drawn.collect()
    assert totals == {0: 500, 1: 1500} and len({r.text for r in got}) == len(got)
    assert all(60 < sum(r.label == y for r in got) < 150 for y in (0, 1))
    monkeypatch.setattr(sq, "SAMPLE_BYTES", 20_000)
    assert sq.sample(make_docs(rows), labels_of(spark, [(i, i % 2, 0) for i, _ in rows]), "quality", F.lit(True))[0].count() < 130
