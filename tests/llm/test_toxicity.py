import random
import time

import numpy as np

from tests.llm.conftest import ODD
from tidewatch.llm import toxicity


def all_maximal(scores):
    """By definition: recursively the best segment (longest shortest-prefix rules aside), then both sides."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    return all_maximal(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]


def test_segments_equal_the_recursive_definition():
    rng = np.random.default_rng(2)
    for _ in range(300):
        # values without ties between sums
        scores = rng.normal(-0.3, 1.0, rng.integers(0, 25))
        want = [(a, b, round(s, 6)) for a, b, s in all_maximal(list(scores))]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)] == want


def corpus(n):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % int(rng.paretovariate(0.6) % 900) for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["Vile,", "rotten", "nasty!", "vermin%d" % rng.randrange(50)])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_texts(spark, make_docs):
    rows, labels = corpus(900)
    truth = {i: y for i, _, y in labels}
    marks = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(make_docs(rows), marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_odd_rows_and_missing_labels(spark, make_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(make_docs(ODD), marks).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    assert toxicity.scored(make_docs([]), marks).count() == 0
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(make_docs(ODD), one).count() == len(ODD)


def test_falling_sums_are_scanned_in_linear_time():
    scores = np.tile([1.0, -2.0], 20_000)
    start = time.perf_counter()
    assert toxicity.maximal_segments(scores) == [(i, i + 1, 1.0) for i in range(0, 40_000, 2)]
    assert time.perf_counter() - start < 3
