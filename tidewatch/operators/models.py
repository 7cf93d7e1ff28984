"""Baselines, forecast statistics and attribution (M1-M12, E27) on ``pyspark.ml`` and column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import metrics, scaling
from tidewatch.operators.series import along
from tidewatch.session import cut_lineage

TOP_FEATURES = 8


# --- M1, M2 -----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class LinearModel:
    """A fitted logistic model: plain numbers, so scoring is a column expression."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    lags: int = 0

    def margin(self) -> Column:
        terms = [F.lit(w) * _lagged(c, lag) for (c, lag), w in zip(self._inputs(), self.weights)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def _inputs(self) -> list[tuple[str, int]]:
        return [(c, lag) for lag in range(self.lags + 1) for c in self.features]

    def names(self) -> list[str]:
        return [c if lag == 0 else f"{c}@t-{lag}" for c, lag in self._inputs()]

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """M2: signed weights, largest first."""
        rows = spark.createDataFrame(list(zip(self.names(), self.weights)), "feature string, weight double")
        return rows.orderBy(F.desc(F.abs("weight")), "feature")


def _lagged(column: str, lag: int) -> Column:
    """A past value inside the split; before its first row, the first row's."""
    if lag == 0:
        return F.col(column).cast("double")
    return F.coalesce(F.lag(column, lag).over(along()), F.first(column).over(along())).cast("double")


def fit_logistic(states: DataFrame, features: list[str], y: str, lags: int = 0, c: float = 1.0, max_iter: int = 200,
                 balanced: bool = True) -> LinearModel | None:
    """M1: L2-regularised logistic regression, classes weighted to equal totals; None when one class is absent."""
    blank = LinearModel(tuple(features), (), 0.0, lags)
    design = states.select(*(_lagged(f, lag).alias(f"x{i}") for i, (f, lag) in enumerate(blank._inputs())),
                           F.col(y).cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in design.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col("label") == 1.0, n / (2.0 * counts[1.0])).otherwise(n / (2.0 * counts[0.0]))
    cols = [f"x{i}" for i in range(len(blank._inputs()))]
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(design.withColumn("weight", weight)).select("features", "label", "weight")
    model = LogisticRegression(weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                               maxIter=max_iter, tol=1e-10).fit(rows)
    return LinearModel(tuple(features), tuple(float(v) for v in model.coefficients.toArray()), float(model.intercept), lags)


def score(states: DataFrame, model: LinearModel | None, name: str = "score") -> DataFrame:
    return states.withColumn(name, F.lit(0.0) if model is None else model.probability())


# --- M3, E27 ----------------------------------------------------------------------------------------------

def leave_out_scores(states: DataFrame, folds: dict[str, list[str]], features: list[str],
                     targets: dict[str, str] = {"comp": "y_within_K", "threat": "y_attack_within_K"}, lags: int = 0,
                     mode: dict | None = None) -> DataFrame:
    """M3: per fold, scaler and models fitted on the other splits, held-out splits scored.

    ``folds`` maps a fold to its held-out splits (leave-one-out: each split its own fold). The loop is over
    folds only; rows stay distributed. The matrix is written once and read by every fold, pruned by split.
    """
    states = cut_lineage(states.select("split", "w", *features, *dict.fromkeys(targets.values())))
    out = None
    for fold, held in folds.items():
        train, test = states.where(~F.col("split").isin(*held)), states.where(F.col("split").isin(*held))
        fitted = scaling.fit(train, features, **(mode or {}))
        inputs = fitted.output_names()
        x_train, x_test = scaling.transform(train, fitted), scaling.transform(test, fitted)
        for channel, y in targets.items():
            model = fit_logistic(x_train, inputs, y, lags)
            rows = score(x_test, model).select(F.lit(fold).alias("fold"), "split", "w", F.lit(channel).alias("channel"), "score",
                                               F.col(y).cast("int").alias("y"))
            out = rows if out is None else out.unionByName(rows)
    return out


def leave_one_out(states: DataFrame) -> dict[str, list[str]]:
    """Each split as its own fold; a model is fitted per fold, so the names are as many as the fits."""
    return {r["split"]: [r["split"]] for r in states.select("split").distinct().orderBy("split").toLocalIterator()}


def probe_auc(rows: DataFrame, features: list[str], y: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified k-fold logistic probe: (fold, roc_auc). Fold ids come from a hash order within each class."""
    order = Window.partitionBy("y", "split").orderBy(F.xxhash64("split", "w", F.lit(seed)))
    classed = rows.select("split", "w", *features, F.col(y).cast("int").alias("y"))
    marked = cut_lineage(classed.withColumn("fold", (F.row_number().over(order) - 1) % folds))
    out = None
    for k in range(folds):
        model = fit_logistic(marked.where(F.col("fold") != k), features, "y")
        scored = score(marked.where(F.col("fold") == k), model)
        out = scored if out is None else out.unionByName(scored)
    return metrics.ranking_metrics(out, ("fold",)).select("fold", "roc_auc")


# --- M4, M5, M12: persistence -----------------------------------------------------------------------------

def persistence_sigma(states: DataFrame, features: list[str], floor: float = 1e-3) -> dict[str, float]:
    """M4: population std of first differences, taken inside each split, never below the floor."""
    d = states.select(*((F.col(f) - F.lag(f).over(along())).alias(f) for f in features))
    row = d.agg(*(F.stddev_pop(f).alias(f) for f in features)).first()
    return {f: max(row[f] or 0.0, floor) for f in features}


def persistence_nll(states: DataFrame, sigma: dict[str, float]) -> DataFrame:
    """M4: per window, mean Gaussian negative log-likelihood of the step from the window before: (split, w, nll)."""
    steps = states.select("split", "w", *((F.col(f) - F.lag(f).over(along())).alias(f) for f in sigma))
    terms = [F.lit(math.log(2 * math.pi * s * s)) + F.col(f) * F.col(f) / F.lit(s * s) for f, s in sigma.items()]
    nll = F.lit(0.5 / len(terms)) * reduce(lambda a, b: a + b, terms)
    return steps.select("split", "w", nll.alias("nll")).where(F.col("nll").isNotNull())


def nll_summary(nll: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    return nll.groupBy(*keys).agg(F.avg("nll").alias("mean"), F.percentile("nll", 0.5).alias("median"), F.percentile("nll", 0.95).alias("p95"))


def persistence_error(states: DataFrame, features: list[str], horizon: int, start: int = 0, every: int = 8) -> DataFrame:
    """M5: mean squared error of "nothing changes" k windows ahead, from every ``every``-th start: (split, k, persistence_mse)."""
    size = F.count("*").over(Window.partitionBy("split"))
    errors = [reduce(lambda a, b: a + b, [F.pow(F.lead(f, k).over(along()) - F.col(f), 2) for f in features]) / len(features)
              for k in range(1, horizon + 1)]
    rows = states.withColumn("_n", size).select("split", "w", "_n", F.array(*errors).alias("e"))
    starts = rows.where((F.col("w") >= start) & ((F.col("w") - start) % every == 0) & (F.col("w") < F.col("_n") - horizon - 1))
    return starts.select("split", F.posexplode("e").alias("k", "v")).groupBy("split", (F.col("k") + 1).alias("k")).agg(
        F.avg("v").alias("persistence_mse"))


def surprise(observed: DataFrame, predicted: DataFrame, log_variance: dict[str, float]) -> DataFrame:
    """Half the mean of logvar + squared error / var of each window under its prediction; both keyed (split, w)."""
    joined = observed.join(predicted.select("split", "w", *(F.col(f).alias(f"_p_{f}") for f in log_variance)), ["split", "w"])
    terms = [F.lit(v) + F.pow(F.col(f"_p_{f}") - F.col(f), 2) / F.lit(math.exp(v)) for f, v in log_variance.items()]
    return joined.select("split", "w", (F.lit(0.5 / len(terms)) * reduce(lambda a, b: a + b, terms)).alias("surprise"))


# --- M6-M8: rollouts --------------------------------------------------------------------------------------

def rollout_curves(rollout: DataFrame) -> DataFrame:
    """M6: from per-step probabilities (split, w, channel, sample, k, p): cumulative curves per k.

    The union over steps is taken per sample, then averaged: ``p_cum``, 5 / 95 % bounds over samples, the step
    difference, and the largest mean step probability of the window.
    """
    path = Window.partitionBy("split", "w", "channel", "sample").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0))
    sure = F.max((p >= 1.0).cast("int")).over(path) == 1
    union = F.when(sure, F.lit(1.0)).otherwise(-F.expm1(F.sum(F.log1p(-F.when(p >= 1.0, F.lit(0.0)).otherwise(p))).over(path)))
    cum = rollout.withColumn("u", union).groupBy("split", "w", "channel", "k").agg(
        F.avg("p").alias("p_raw"), F.avg("u").alias("p_cum"), F.percentile("u", 0.05).alias("p_lo"), F.percentile("u", 0.95).alias("p_hi"))
    steps = Window.partitionBy("split", "w", "channel").orderBy("k")
    return cum.withColumns({"p_step": F.col("p_cum") - F.coalesce(F.lag("p_cum").over(steps), F.lit(0.0)),
                            "p_max": F.max("p_raw").over(Window.partitionBy("split", "w", "channel"))})


def alarm_statistics(curves: DataFrame) -> DataFrame:
    """M7: candidate alarm scores per window, long form: union, max, mean, first and last step."""
    first, last = F.min("k").over(Window.partitionBy("split", "w", "channel")), F.max("k").over(Window.partitionBy("split", "w", "channel"))
    rows = curves.withColumns({"_a": first, "_z": last})
    wide = rows.groupBy("split", "w", "channel").agg(
        F.max(F.when(F.col("k") == F.col("_z"), F.col("p_cum"))).alias("cumulative_union"), F.max("p_raw").alias("max_over_horizon"),
        F.avg("p_raw").alias("mean_over_horizon"), F.max(F.when(F.col("k") == F.col("_a"), F.col("p_raw"))).alias("step_1"),
        F.max(F.when(F.col("k") == F.col("_z"), F.col("p_raw"))).alias("step_K"))
    return wide.unpivot(["split", "w", "channel"], ["cumulative_union", "max_over_horizon", "mean_over_horizon", "step_1", "step_K"], "rule", "score")


def ensemble_mean(scores: DataFrame, members: int) -> DataFrame:
    """M8: mean per (split, w, channel) over runs; a window not scored by every member is an error."""
    whole = F.when(F.col("_k") == members, F.col("score")).otherwise(F.raise_error(F.lit("ensemble members scored different windows")))
    return (scores.groupBy("split", "w", "channel").agg(F.avg("score").alias("score"), F.count("*").alias("_k"))
            .select("split", "w", "channel", whole.cast("double").alias("score")))


# --- M9-M11: attribution ----------------------------------------------------------------------------------

def attribution(states: DataFrame, model: LinearModel) -> DataFrame:
    """M9: path-integrated gradient from the all-zero state, in closed form for a linear margin.

    attr_i = w_i x_i (s(z) - s(b)) / (z - b), with its limit w_i x_i s'(b) where z = b. Long form: (split, w,
    feature, value, attribution).
    """
    b = model.intercept
    base = 1.0 / (1.0 + math.exp(-b))
    z = model.margin()
    rows = states.withColumn("_z", z)
    gain = (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))) - F.lit(base)) / (F.col("_z") - F.lit(b))
    factor = F.when(F.abs(F.col("_z") - F.lit(b)) < 1e-12, F.lit(base * (1 - base))).otherwise(gain)
    items = [F.struct(F.lit(name).alias("feature"), _lagged(c, lag).alias("value"), (F.lit(w) * _lagged(c, lag) * factor).alias("attribution"))
             for name, (c, lag), w in zip(model.names(), model._inputs(), model.weights)]
    return rows.select("split", "w", F.explode(F.array(*items)).alias("a")).select("split", "w", "a.*")


def top_features(attributions: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    order = Window.partitionBy("split", "w").orderBy(F.desc(F.abs("attribution")), "feature")
    direction = F.when(F.col("attribution") >= 0, "up").otherwise("down")
    return attributions.withColumns({"rank": F.row_number().over(order), "direction": direction}).where(F.col("rank") <= k)


def global_attribution(attributions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return attributions.groupBy(*keys, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution"))


def windows_to_explain(alarms: DataFrame, limit: int = 24, every: int = 8) -> DataFrame:
    """The strongest alarms of each split and a regular sample of windows."""
    order = Window.partitionBy("split", "alarm").orderBy(F.desc("score"), "w")
    strongest = F.col("alarm") & (F.row_number().over(order) <= limit)
    return alarms.withColumn("_s", strongest).where(F.col("_s") | (F.col("w") % every == 0)).drop("_s")


def reliance(states: DataFrame, model: LinearModel, flagged: list[str], keys: tuple[str, ...] = ("split",), y: str = "y") -> DataFrame:
    """ROC-AUC change per feature when it is set to 0, and when every flagged feature is.

    A linear margin without a feature is the margin minus its term, so each row carries its margins and no model
    is run again: (keys, feature, roc_auc, delta).
    """
    terms = dict(zip(model.features, model.weights))
    z = model.margin()
    gone = reduce(lambda a, b: a + b, [F.lit(terms[f]) * F.col(f) for f in flagged], F.lit(0.0))
    cases = [F.struct(F.lit("").alias("feature"), z.alias("score")), F.struct(F.lit("*flagged*").alias("feature"), (z - gone).alias("score"))]
    cases += [F.struct(F.lit(f).alias("feature"), (z - F.lit(w) * F.col(f)).alias("score")) for f, w in terms.items()]
    rows = states.select(*keys, F.col(y).alias("y"), F.explode(F.array(*cases)).alias("c")).select(*keys, "y", "c.*")
    auc = metrics.ranking_metrics(rows, (*keys, "feature")).select(*keys, "feature", "roc_auc")
    base = auc.where(F.col("feature") == "").select(*keys, F.col("roc_auc").alias("base"))
    return auc.where(F.col("feature") != "").join(base, list(keys)).withColumn("delta", F.col("roc_auc") - F.col("base"))
