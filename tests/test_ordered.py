import random

import numpy as np
import pytest

from tidewatch.operators import alerts
from tidewatch.operators.ordered import WIDE, Counted, packed, unpacked


def test_counted_blocks_equal_a_sorted_list():
    rng = random.Random(1)
    stored, index = {}, None
    values = []
    for _ in range(12):  # reopened from what was stored, as a stream does
        own = Counted(index, lambda i: unpacked(stored[i]))
        for _ in range(400):
            value = rng.choice([rng.random(), 0.5, -1.0, 3.0])
            own.insert(value)
            values.append(value)
            values.sort()
            rank = rng.randrange(len(values))
            assert own.at(rank) == values[rank]
        assert own.quantile(0.9) == pytest.approx(np.quantile(values, 0.9))
        stored.update({i: packed(own.blocks[i]) for i in own.changed})
        index = (own.lows, own.counts, own.ids)
        assert own.size == len(values) and max(own.counts) <= WIDE
    assert Counted().quantile(0.5) is None


@pytest.mark.parametrize("quantile", [0.0, 0.5, 0.9, 1.0])
def test_expanding_threshold_by_blocks_equals_every_prefix(spark, quantile):
    rng = random.Random(2)
    series = {"a": [rng.gauss(0, 1) for _ in range(700)], "b": [rng.choice([0.0, 1.0, 2.0]) for _ in range(301)],
              "c": [float(i) for i in range(260)], "d": [float(-i) for i in range(260)], "e": [1.0], "f": [rng.random() + i * (i > 300) for i in range(600)]}
    rows = [(s, w * 2, v, "x") for s, vs in series.items() for w, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "split string, w bigint, score double, other string").repartition(3)
    got = {(r.split, r.w): r for r in alerts._expanding(df, quantile, (), block=40).collect()}
    assert len(got) == len(rows) and all(r.other == "x" for r in got.values())
    for s, vs in series.items():
        for t in range(len(vs)):
            expected = float(np.quantile(vs[:t], quantile)) if t else None
            threshold = got[s, t * 2].threshold
            assert threshold == expected if expected is None else threshold == pytest.approx(expected, abs=1e-12), (s, t)


def test_quantile_of_all_other_splits(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(alerts, "STRIP", 16)
    series = {"a": [rng.gauss(0, 1) for _ in range(200)], "b": [rng.choice([0.0, 1.0]) for _ in range(150)], "c": [5.0], "d": [rng.random() for _ in range(40)], "e": [9.0] * 300}
    df = spark.createDataFrame([(s, v) for s, vs in series.items() for v in vs], "split string, score double")
    for quantile in (0.0, 0.3, 0.95, 1.0):
        got = {r.split: r.threshold for r in alerts.others_threshold(df, quantile).collect()}
        for s in series:
            rest = [v for k, vs in series.items() if k != s for v in vs]
            assert got[s] == pytest.approx(np.quantile(rest, quantile), abs=1e-12), (s, quantile)
    assert alerts.others_threshold(df.where("split = 'a'"), 0.5).count() == 0
