import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.normal import probit
from tidewatch.operators import metrics, models, scaling
from tidewatch.plans import build, scorecard


def test_probit(spark):
    ps = [1e-12, 1e-6, 0.01, 0.075, 0.3, 0.5, 0.77, 0.93, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", probit(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9)
    assert spark.range(1).select(probit(F.lit(0.0)), probit(F.lit(1.0))).first() == (None, None)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(3)
    rows = []
    for s in range(3):
        for w in range(80):
            heavy, signed = rng.lognormvariate(0, 2), rng.gauss(0, 1)
            y = int(signed + rng.gauss(0, .6) > .8)
            rows.append((f"s{s}", w, heavy, signed, 5.0, y, y))
    return spark.createDataFrame(rows, "split string, w bigint, heavy double, signed double, flat double, y_within_K int, y_attack_within_K int")


def test_scaler(spark, matrix, tmp_path):
    cols = ["heavy", "signed", "flat"]
    s = scaling.fit(matrix, cols)
    assert s.logged == (True, False, False) and s.std[2] == 1.0
    z = scaling.transform(matrix, s)
    row = z.agg(*(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    assert row[0:3] == pytest.approx((0, 0, 0), abs=1e-9) and row[3:6] == pytest.approx((1, 1, 0), abs=1e-9)
    back = scaling.inverse(z, s).select("split", "w", *cols).collect()
    want = {(r["split"], r["w"]): r for r in matrix.collect()}
    assert all(r["heavy"] == pytest.approx(want[r["split"], r["w"]]["heavy"]) for r in back)
    scaling.save(s, spark, str(tmp_path / "s"))
    assert scaling.load(spark, str(tmp_path / "s")) == s
    with pytest.raises(ValueError):
        scaling.transform(matrix.drop("flat"), s)
    with pytest.raises(ValueError):
        scaling.fit(matrix, cols, mode="relative")
    with pytest.raises(NotImplementedError):
        scaling.inverse(matrix, scaling.fit(matrix, cols, mode="rank"))


def test_ranks_stay_in_their_split_and_in_the_past(matrix):
    whole = scaling.transform(matrix, scaling.fit(matrix, ["heavy", "flat"], mode="rank"))
    alone = scaling.transform(matrix.where("split = 's1'"), scaling.fit(matrix, ["heavy", "flat"], mode="rank"))
    assert sorted(map(tuple, whole.where("split = 's1'").collect())) == sorted(map(tuple, alone.collect()))
    assert whole.where("abs(flat) > 1e-12").count() == 0
    causal = scaling.Scaling(("heavy",), mode="rank", rank_window=20)
    a = scaling.transform(matrix, causal).where("w < 40").orderBy("split", "w").collect()
    changed = matrix.withColumn("heavy", F.when(F.col("w") >= 40, 1e9).otherwise(F.col("heavy")))
    b = scaling.transform(changed, causal).where("w < 40").orderBy("split", "w").collect()
    assert [r["heavy"] for r in a] == [r["heavy"] for r in b] and all(r["heavy"] == 0 for r in a if r["w"] < 9)


def test_logistic_solves_the_weighted_objective(matrix):
    """The gradient of the balanced, L2-regularised loss is zero at the fitted weights."""
    model = models.fit_logistic(matrix, ["signed", "flat"], "y_within_K")
    rows = matrix.select("signed", "flat", "y_within_K").collect()
    n, pos = len(rows), sum(r[2] for r in rows)
    grad = [0.0, 0.0, 0.0]
    for x1, x2, y in rows:
        p = 1 / (1 + math.exp(-(model.intercept + model.weights[0] * x1 + model.weights[1] * x2)))
        wt = n / (2 * pos) if y else n / (2 * (n - pos))
        for i, x in enumerate((x1, x2, 1.0)):
            grad[i] += wt * (p - y) * x
    grad[0] += model.weights[0]
    grad[1] += model.weights[1]
    assert max(map(abs, grad)) < 1e-3 * n
    assert model.weights[0] > 0


def test_lags_repeat_the_first_row(matrix):
    model = models.LinearModel(("signed",), (0.0, 1.0), 0.0, lags=1)
    rows = matrix.where("split = 's0'").withColumn("m", model.margin()).orderBy("w").collect()
    assert rows[0]["m"] == rows[0]["signed"] and rows[5]["m"] == rows[4]["signed"] and model.names() == ["signed", "signed@t-1"]


def test_folds_and_single_class(matrix):
    folds = models.leave_one_out(matrix)
    assert folds == {"s0": ["s0"], "s1": ["s1"], "s2": ["s2"]}
    out = models.leave_out_scores(matrix, {"f": ["s0"]}, ["heavy", "signed"])
    assert out.count() == 160 and metrics.ranking_metrics(out.where("channel = 'comp'")).first()["roc_auc"] > 0.8
    assert models.fit_logistic(matrix.where("y_within_K = 0"), ["signed"], "y_within_K") is None
    assert models.score(matrix, None).agg(F.max("score")).first()[0] == 0


def test_attribution_sums_to_the_score_change(matrix):
    model = models.LinearModel(("heavy", "signed"), (0.3, -1.2), 0.4)
    total = models.attribution(matrix, model).groupBy("split", "w").agg(F.sum("attribution").alias("a"))
    joined = models.score(matrix, model).join(total, ["split", "w"]).collect()
    base = 1 / (1 + math.exp(-0.4))
    assert all(r["a"] == pytest.approx(r["score"] - base, abs=1e-9) for r in joined)


def test_ensemble_needs_every_member(spark):
    rows = [("d", 0, "comp", 0.2), ("d", 0, "comp", 0.4), ("d", 1, "comp", 0.9)]
    df = spark.createDataFrame(rows, "split string, w bigint, channel string, score double")
    assert models.ensemble_mean(df.where("w = 0"), 2).first()["score"] == pytest.approx(0.3)
    with pytest.raises(Exception, match="different windows"):
        models.ensemble_mean(df, 2).collect()


def test_capture_report_end_to_end(spark, make_flows):
    import json
    rng = random.Random(1)
    rows = [{"at": rng.uniform(0, 1800), "dst_port": rng.randint(1, 400), "src_ip": f"192.168.10.{rng.randint(1, 9)}"} for _ in range(300)]
    rows += [{"at": 1500 + i, "stage": 3, "label": "Infiltration", "dst_port": 1000 + i} for i in range(60)] + [{"at": 0}]
    flows = make_flows(rows)
    grid = build.Grid.fit(flows)
    report = build.capture_report(flows, grid, ("192.168.10.",), lambda s: s.withColumn("score", F.col("uniq_dst_port"))).first()
    doc = json.loads(report["payload"])
    assert len(doc["timeline"]) == grid.spans.first()["n"] and doc["timeline"][0]["threshold"] is None
    assert doc["lead_time_summary"]["episodes"] == 1 and len(doc["stages"]) == 7 and doc["alarms"]
    assert [t["w"] for t in doc["timeline"]] == sorted(t["w"] for t in doc["timeline"])


def test_floors_and_roles(make_scores, make_stages):
    stages = make_stages([0, 3, 0], "a").unionByName(make_stages([0, 6, 0], "b"))
    roles = {r["split"]: (r["attack_role"], r["compromise_role"]) for r in scorecard.split_roles(stages).collect()}
    assert roles == {"a": (True, True), "b": (False, False)}
