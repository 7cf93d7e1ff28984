import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.quantiles import grouped_quantiles, running_totals
from tidewatch.operators import alerts, episodes, metrics


def _quantile(values, q):
    s = sorted(values)
    at = q * (len(s) - 1)
    lo = int(at)
    return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (at - lo)


def test_silent_while_warming_up(make_scores):
    out = alerts.causal_threshold(make_scores([1.0] * 50)).orderBy("w").collect()
    assert not any(r["alarm"] for r in out[:20]) and all(r["alarm"] for r in out[20:])
    assert all(r["threshold"] is None for r in out[:20])


@pytest.mark.parametrize("trailing", [None, 30])
@pytest.mark.parametrize("grouped", [True, False])
def test_threshold_is_the_quantile_of_the_past(make_scores, trailing, grouped):
    rng = random.Random(1)
    s = [rng.choice([rng.random(), 0.5]) for _ in range(120)]
    out = alerts.causal_threshold(make_scores(s), 0.9, trailing=trailing, grouped=grouped).orderBy("w").collect()
    for t in range(20, 120):
        past = s[:t] if trailing is None else s[max(0, t - trailing):t]
        assert out[t]["threshold"] == pytest.approx(_quantile(past, 0.9), abs=1e-12)


def test_trailing_forgets(make_scores):
    out = alerts.causal_threshold(make_scores([10.0] * 100 + [0.0] * 100), 0.9, trailing=60).orderBy("w").collect()
    assert out[99]["threshold"] == 10 and out[199]["threshold"] == 0


def test_the_future_does_not_move_the_past(make_scores):
    rng = random.Random(2)
    s = [rng.random() for _ in range(80)]
    a = alerts.causal_threshold(make_scores(s)).where("w < 50").orderBy("w").collect()
    b = alerts.causal_threshold(make_scores(s[:50] + [99.0] * 30)).where("w < 50").orderBy("w").collect()
    assert [r["threshold"] for r in a] == [r["threshold"] for r in b]


def _brute_lead(alarm, eligible, onset, horizon, p, confirm):
    a = [x and e for x, e in zip(alarm, eligible)] if eligible else alarm
    for t in range(max(0, onset - horizon), onset):
        if confirm and t + p > onset:
            return None
        if t + p <= len(a) and all(a[t:t + p]):
            return t
    return None


@pytest.mark.parametrize("confirm,masked,p", [(False, False, 1), (False, False, 3), (True, True, 2), (True, False, 2)])
def test_lead_times_against_the_definition(spark, confirm, masked, p):
    rng = random.Random(p * 10 + confirm)
    n, rows, onsets = 60, [], []
    for s in range(25):
        for w in range(n):
            rows.append((f"s{s}", w, rng.random(), rng.random() < 0.4, rng.random() < 0.7))
        onsets += [(f"s{s}", o) for o in rng.sample(range(n), 3)]
    alarms = spark.createDataFrame(rows, "split string, w bigint, score double, alarm boolean, eligible boolean")
    table = spark.createDataFrame(onsets, "split string, onset_w bigint")
    got = {(r["split"], r["onset_w"]): r["first_alarm"] for r in episodes.lead_times(alarms, table, 8, p, confirm, masked).collect()}
    for s, o in onsets:
        series = [r for r in rows if r[0] == s]
        want = _brute_lead([r[3] for r in series], [r[4] for r in series] if masked else None, o, 8, p, confirm)
        assert got[s, o] == want


def test_null_counts_rotations(spark):
    rng = random.Random(4)
    n, k, shifts = 90, 8, 30
    alarm = [rng.random() < 0.35 for _ in range(n)]
    eligible = [rng.random() < 0.8 for _ in range(n)]
    onsets = [20, 47, 80]
    alarms = spark.createDataFrame([("d", w, 0.0, alarm[w], eligible[w]) for w in range(n)], "split string, w bigint, score double, alarm boolean, eligible boolean")
    table = spark.createDataFrame([("d", o) for o in onsets], "split string, onset_w bigint")
    shift = F.col("min_shift") + F.pmod(F.col("i").cast("bigint") * 31, F.col("n") - 2 * F.col("min_shift"))
    row = episodes.circular_shift_null(alarms, table, k, 2, shifts, shift=shift).first()
    count = lambda a: sum(_brute_lead(a, eligible, o, k, 2, True) is not None for o in onsets)
    counts = [count([alarm[(w - (k + (i * 31) % (n - 2 * k))) % n] for w in range(n)]) for i in range(shifts)]
    assert row["observed"] == count(alarm) and row["null_mean"] == pytest.approx(sum(counts) / shifts)
    assert row["p_value"] == pytest.approx((1 + sum(c >= row["observed"] for c in counts)) / (1 + shifts))


@pytest.mark.parametrize("persistence,confirm", [(1, True), (2, False), (3, True)])
def test_two_thousand_rotations_equal_the_loop(spark, persistence, confirm):
    """Repeated onsets count twice, horizons reach over the start, one split has no alarm and one no onset."""
    rng = random.Random(persistence)
    k, shifts, series, onsets = 6, 2000, {}, {"a": [3, 30, 30, 52, 79], "b": [10, 40], "c": []}
    for s, n, p in (("a", 80, 0.4), ("b", 60, 0.0), ("c", 50, 0.5)):
        series[s] = ([rng.random() < p for _ in range(n)], [rng.random() < 0.75 for _ in range(n)])
    alarms = spark.createDataFrame([(s, w, 0.0, a, e) for s, (xs, es) in series.items() for w, (a, e) in enumerate(zip(xs, es))],
                                   "split string, w bigint, score double, alarm boolean, eligible boolean")
    table = spark.createDataFrame([(s, o) for s, os_ in onsets.items() for o in os_], "split string, onset_w bigint")
    shift = F.col("min_shift") + F.pmod(F.col("i").cast("bigint") * 31, F.col("n") - 2 * F.col("min_shift"))
    out = episodes.circular_shift_null(alarms, table, k, persistence, shifts, confirm, shift=shift)
    assert "array<" not in out._jdf.queryExecution().optimizedPlan().toString()
    for row in out.collect():
        alarm, eligible = series[row["split"]]
        n = len(alarm)
        count = lambda a: sum(_brute_lead(a, eligible, o, k, persistence, confirm) is not None for o in onsets[row["split"]])
        if not onsets[row["split"]]:
            assert (row["n_shifts"], row["observed"], row["p_value"]) == (0, 0, 1.0)
            continue
        counts = [count([alarm[(w - (k + (i * 31) % (n - 2 * k))) % n] for w in range(n)]) for i in range(shifts)]
        assert (row["observed"], row["n_shifts"], row["null_max"]) == (count(alarm), shifts, max(counts))
        assert row["null_mean"] == pytest.approx(sum(counts) / shifts)
        assert row["p_value"] == pytest.approx((1 + sum(c >= row["observed"] for c in counts)) / (1 + shifts))


def test_null_needs_room(spark):
    alarms = spark.createDataFrame([("d", w, 0.0, True) for w in range(10)], "split string, w bigint, score double, alarm boolean")
    table = spark.createDataFrame([("d", 5)], "split string, onset_w bigint")
    row = episodes.circular_shift_null(alarms, table, 8, 2, 10).first()
    assert row["n_shifts"] == 0 and row["p_value"] == 1.0 and not row["exceeds_p95"]


def test_fisher(spark):
    df = spark.createDataFrame([(0.05,), (0.2,), (0.0,)], "p_value double")
    row = episodes.fisher_combine(df).first()
    x = -2 * (math.log(0.05) + math.log(0.2) + math.log(1e-12))
    assert row["chi2"] == pytest.approx(x)
    assert row["p_combined"] == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2))


@pytest.mark.parametrize("seed", range(3))
def test_auc_is_pair_counting(make_scores, seed):
    rng = random.Random(seed)
    s = [rng.randint(0, 12) / 10 for _ in range(150)]
    y = [int(rng.random() < 0.3) for _ in s]
    row = metrics.ranking_metrics(make_scores(s, y=y)).first()
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    assert row["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = [q for v, q in zip(s, y) if v >= t]
        ap += (sum(hit) / sum(y) - before) * sum(hit) / len(hit)
        before = sum(hit) / sum(y)
    assert row["pr_auc"] == pytest.approx(ap)


def test_single_class_has_no_auc(make_scores):
    row = metrics.ranking_metrics(make_scores([0.1, 0.2, 0.3])).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_confusion_zero_denominators(make_scores):
    row = metrics.confusion(make_scores([0.1, 0.2]).withColumn("alarm", F.lit(False))).first()
    assert (row["precision"], row["recall"], row["f1"], row["fpr"]) == (0, 0, 0, 0)


def test_best_threshold_is_the_lowest_best(make_scores):
    rng = random.Random(9)
    for positives in (0.3, 0.0):
        s = [round(rng.random(), 2) for _ in range(60)]
        y = [int(rng.random() < positives) for _ in s]
        grid = [0.01 + i * (0.99 - 0.01) / 100 for i in range(100)] + [0.99]

        def f1(t):
            tp = sum(v >= t and q for v, q in zip(s, y))
            k = sum(v >= t for v in s) + sum(y)
            return 2 * tp / k if k else 0.0

        want = max(grid, key=f1)
        row = metrics.best_threshold(make_scores(s, y=y)).first()
        assert row["threshold"] == pytest.approx(want) and row["f1"] == pytest.approx(f1(want))


def test_quantiles_of_a_skewed_group(spark):
    """One group holds most rows and one value most of that group; answers stay exact."""
    rng = random.Random(6)
    rows = [("hot", 1.0)] * 700 + [("hot", rng.random()) for _ in range(500)] + [("cold", rng.random()) for _ in range(7)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "m": 0.5, "z": 1.0}).collect()}
    for g in ("hot", "cold"):
        values = [v for k, v in rows if k == g]
        for name, q in (("a", 0.0), ("b", 0.37), ("m", 0.5), ("z", 1.0)):
            assert got[g][name] == pytest.approx(_quantile(values, q), abs=1e-12)


def test_running_totals_descend_too(spark):
    df = spark.createDataFrame([("g", float(i), i) for i in range(100)], "g string, v double, c int")
    got = {r["v"]: r["cum_c"] for r in running_totals(df, ["g"], "v", ["c"], ascending=False).collect()}
    assert all(got[float(i)] == sum(range(i, 100)) for i in range(100))


def test_temperature_recovers_a_known_one(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(4000):
        z = rng.gauss(0, 2)
        rows.append(("d", 1 / (1 + math.exp(-z * 2.0)), int(rng.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame(rows, "split string, score double, y int")
    t = metrics.fit_temperature(df)
    assert 1.7 < t < 2.4

    def loss(t):
        total = 0.0
        for _, p, y in rows:
            p = min(max(p, 1e-7), 1 - 1e-7)
            q = 1 / (1 + math.exp(-math.log(p / (1 - p)) / t))
            q = min(max(q, 1e-7), 1 - 1e-7)
            total -= y * math.log(q) + (1 - y) * math.log(1 - q)
        return total

    assert loss(t) <= min(loss(t * 1.01), loss(t / 1.01)) + 1e-9


def test_alarm_runs(spark):
    alarm = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    rows = [("d", w, w / 10, 0.5, bool(a)) for w, a in enumerate(alarm)]
    alarms = spark.createDataFrame(rows, "split string, w bigint, score double, threshold double, alarm boolean")
    onsets = spark.createDataFrame([("d", 3), ("d", 5)], "split string, onset_w bigint")
    got = [(r["begin_w"], r["end_w"], r["sustained"], r["onset_w"], r["lead_windows"]) for r in alerts.alarm_runs(alarms, onsets, 4, 30.0).orderBy("begin_w").collect()]
    assert got == [(1, 2, True, 3, 2), (4, 4, False, None, None), (7, 9, True, None, None)]
