import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewatch.llm import langid

SYLLABLES = {"aa": ["the", "and", "ing", "er"], "bb": ["ción", "los", "que", "ñ"], "cc": ["sch", "ung", "ü", "der"]}


def corpus(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_determinism(spark):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predicted(docs).collect()
    held = [r for r in got if r.held_out]
    truth = {i: lang for i, _, lang in rows}
    assert len(held) > 80 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 3
    again = {r.doc_id: r for r in langid.predicted(docs.orderBy(F.desc("doc_id")).repartition(3)).collect()}
    assert all(abs(again[r.doc_id].score - r.score) < 1e-6 and again[r.doc_id].lang_pred == r.lang_pred for r in got)


def test_prediction_equals_a_plain_average():
    rng = np.random.default_rng(0)
    table = np.concatenate([rng.normal(size=(langid.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32)
    model = langid.Model(["x", "y"], table, 1.0, 0.0)
    texts = ["Abc def", "a", "", "ñandú 12 Z", "q" * 50]
    best, score = langid.classify(pa.array(texts), model)
    for text, b, s in zip(texts, best, score):
        body = np.frombuffer(text.encode(), np.uint8)
        rows = []
        for order in langid.ORDERS:
            for i in range(len(body) - order + 1):
                one = langid._LETTER[body[i:i + order]]
                rows.append(table[langid.buckets_of(one, np.array([0, order]), order)[0]])
        z = np.mean(rows, axis=0) if rows else np.zeros(2)
        p = np.exp(z) / np.exp(z).sum()
        assert b == p.argmax() and abs(s - p.max()) < 1e-4


def test_odd_rows(make_docs):
    got = {r.doc_id: r for r in langid.predicted(make_docs(ODD + [(i, "plain words of one language") for i in range(20, 60)])).collect()}
    for i in (1, 2, 3, 4):
        assert got[i].lang_pred == "und" and got[i].score == 0.0 and got[i].rejected
    assert got[5].lang_pred == got[None].lang_pred == "en"
    assert langid.predicted(make_docs([])).count() == 0
    nothing = make_docs([(1, "a b")]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in langid.predicted(nothing).collect()] == ["und"]
    docs = make_docs([(i, "plain words of one language") for i in range(20, 60)] + [(1, None)])
    kept = langid.keep_recognised(docs)
    assert kept.columns == docs.columns and kept.count() == 40
