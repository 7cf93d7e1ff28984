"""Detection and calibration metrics as grouped aggregates.

Pooled groups may hold any number of windows, so nothing here sorts a whole group in one task: rankings count
equal scores first and use running totals in pieces (``functions.quantiles``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.quantiles import grouped_quantiles, running_totals
from tidewatch.schema import STAGES


def _ratio(a: Column, b: Column) -> Column:
    """0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --- E5 ---------------------------------------------------------------------------------------------------

def confusion(alarms: DataFrame, keys: tuple[str, ...] = ("split",), alarm: str = "alarm", y: str = "y") -> DataFrame:
    """E5: tp, fp, fn, tn and precision, recall, F1, false-positive rate, alarm rate; sums come before ratios."""
    a, t = F.col(alarm).cast("boolean"), F.col(y).cast("int") == 1
    counts = alarms.groupBy(*keys).agg(
        F.count_if(a & t).alias("tp"), F.count_if(a & ~t).alias("fp"), F.count_if(~a & t).alias("fn"),
        F.count_if(~a & ~t).alias("tn"), F.count_if(t).alias("positives"), F.count("*").alias("n"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": _ratio(fp, fp + tn), "alarm_rate": _ratio(tp + fp, F.col("n"))})


# --- E6, E7 -----------------------------------------------------------------------------------------------

def ranking_metrics(scored: DataFrame, keys: tuple[str, ...] = ("split",), score: str = "score", y: str = "y",
                    weight: str | None = None) -> DataFrame:
    """E6 + E7: ROC-AUC (ties at half) and average precision (tied scores as one step); null for one class."""
    w = F.col(weight) if weight else F.lit(1)
    t = F.col(y).cast("int") == 1
    counted = scored.groupBy(*keys, score).agg(
        F.sum(F.when(t, w).otherwise(0)).alias("pos"), F.sum(F.when(t, 0).otherwise(w)).alias("neg"))
    keyed = counted if keys else counted.withColumn("_all", F.lit(1))
    group = list(keys) or ["_all"]
    ranked = running_totals(keyed, group, score, ["pos", "neg"])
    totals = keyed.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = ranked.join(totals, group)
    below = F.col("cum_neg") - F.col("neg")
    tp, fp = F.col("P") - F.col("cum_pos") + F.col("pos"), F.col("N") - F.col("cum_neg") + F.col("neg")
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return rows.groupBy(*group, "P", "N").agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("wins"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp))).alias("steps"),
    ).select(*keys, F.when(both, F.col("wins") / F.col("P") / F.col("N")).alias("roc_auc"),
             F.when(both, F.col("steps") / F.col("P")).alias("pr_auc"))


# --- E4 ---------------------------------------------------------------------------------------------------

def best_threshold(scored: DataFrame, keys: tuple[str, ...] = ("split",), grid: int = 101) -> DataFrame:
    """The threshold on an even grid over [0.01, 0.99] with the highest F1 (the lowest such one).

    Each score is reduced to how many grid thresholds it reaches; F1 at every threshold then follows from at
    most ``grid + 1`` counts per group, without pairing scores and thresholds.
    """
    step = (0.99 - 0.01) / (grid - 1)
    levels = [0.01 + i * step for i in range(grid - 1)] + [0.99]
    table = F.array(*(F.lit(x) for x in levels))
    reached = F.size(F.filter(table, lambda x: x <= F.col("score")))
    t = F.col("y").cast("int") == 1
    counts = scored.withColumn("reach", reached).groupBy(*keys, "reach").agg(
        F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    down = Window.partitionBy(*keys).orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy("reach")
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    total = F.sum("pos").over(Window.partitionBy(*keys))
    lines = counts.withColumns({"f1": _ratio(2 * tp, tp + fp + total), "at": F.coalesce(F.lag("reach").over(up), F.lit(0))})
    real = F.col("reach") > 0
    best = lines.groupBy(*keys).agg(
        F.coalesce(F.min_by(F.when(real, F.col("at")), F.when(real, F.struct((-F.col("f1")).alias("f"), "at"))), F.lit(0)).alias("at"),
        F.coalesce(F.max(F.when(real, F.col("f1"))), F.lit(0.0)).alias("f1"))
    at = F.when(F.col("f1") > 0, F.col("at")).otherwise(F.lit(0))
    return best.select(*keys, F.element_at(table, at + 1).alias("threshold"), "f1")


# --- E17-E20: comparisons over runs -----------------------------------------------------------------------

def paired_comparison(candidate: DataFrame, base: DataFrame, metrics: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per metric, deltas candidate - base over shared seeds: mean, seeds, seeds improved.

    ``keys`` are columns that tell several candidates apart; each is paired with the same base.
    """
    values = [F.col(m).cast("double").alias(m) for m in metrics]
    a = candidate.select(*keys, "seed", *values).unpivot([*keys, "seed"], metrics, "metric", "a")
    b = base.select("seed", *values).unpivot("seed", metrics, "metric", "b")
    d = F.col("a") - F.col("b")
    return a.join(b, ["seed", "metric"]).groupBy(*keys, "metric").agg(
        F.count("*").alias("seeds"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("seeds_up"),
        F.min("a").alias("candidate_min"))


def adoption_rule(comparison: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The three clauses of the seed-paired bar on a ``paired_comparison`` table, per candidate (``keys``)."""
    def pick(metric: str, col: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(col)))

    clauses = comparison.groupBy(*keys).agg(
        ((pick("s2_star", "mean_delta") >= 0.03) & (pick("s2_star", "seeds_up") >= 2)).alias("anticipation"),
        ((pick("s1_precision", "mean_delta") > -0.05) & (pick("s1_fpr", "mean_delta") < 0.02)).alias("alarm_cost"),
        (pick("pr_auc", "candidate_min") >= 0.20).alias("stability"))
    return clauses.withColumns({
        "adopted": F.col("anticipation") & F.col("alarm_cost") & F.col("stability"),
        "non_inferior": F.col("alarm_cost") & F.col("stability")})


def ablation_deltas(results: DataFrame, control: str, metrics: dict[str, bool]) -> DataFrame:
    """Difference from the control arm at the same (seed, fold); ``metrics`` maps name -> higher is worse."""
    ref = results.where(F.col("arm") == control).select("seed", "fold", *(F.col(m).alias(f"_{m}") for m in metrics))
    out = results.join(ref, ["seed", "fold"])
    for m, worse_up in metrics.items():
        delta = F.col(m) - F.col(f"_{m}")
        out = out.withColumn(f"{m}_vs_{control}", delta if worse_up else -delta).drop(f"_{m}")
    return out


def rollout_gain(curves: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Mean over k >= 2 of persistence error minus model error, from (keys, k, model_mse, persistence_mse)."""
    return curves.where(F.col("k") >= 2).groupBy(*keys).agg(
        F.avg(F.col("persistence_mse") - F.col("model_mse")).alias("rollout_gain"))


def seed_summary(results: DataFrame, keys: tuple[str, ...], metrics: list[str]) -> DataFrame:
    """Mean, min and max over seeds."""
    return results.groupBy(*keys).agg(*(agg(m).alias(f"{m}_{name}") for m in metrics for name, agg in
                                        (("mean", F.avg), ("min", F.min), ("max", F.max))))


def family_verdict(results: DataFrame, transfers_at: float = 0.70, inverted_below: float = 0.50, seeds: int = 2) -> DataFrame:
    """Per family from (family, split, seed, roc_auc): inverted / transfers / partial, by counts over seeds."""
    per = results.groupBy("family", "split").agg(
        F.count_if(F.col("roc_auc") >= transfers_at).alias("high"), F.count_if(F.col("roc_auc") < inverted_below).alias("low"),
        F.avg("roc_auc").alias("roc"))
    fam = per.groupBy("family").agg(
        F.count("*").alias("splits"), F.bool_and(F.col("high") >= seeds).alias("transfers"),
        F.bool_or(F.col("low") >= seeds).alias("inverted"), F.avg("roc").alias("roc_auc_mean"))
    verdict = F.when(F.col("inverted"), "inverted").when(F.col("transfers"), "transfers").otherwise("partial")
    return fam.select("family", "splits", "roc_auc_mean", verdict.alias("verdict"))


def primary_target(scores: DataFrame, states: DataFrame, compromise_splits: DataFrame) -> DataFrame:
    """Compromise score and label where a split has compromise onsets, else the threat pair."""
    role = compromise_splits.select("split").distinct().withColumn("_c", F.lit(True))
    wide = scores.groupBy("split", "w").agg(
        F.max(F.when(F.col("channel") == "comp", F.col("score"))).alias("comp"),
        F.max(F.when(F.col("channel") == "threat", F.col("score"))).alias("threat"))
    joined = wide.join(states.select("split", "w", "y_within_K", "y_attack_within_K"), ["split", "w"]).join(role, "split", "left")
    has = F.coalesce(F.col("_c"), F.lit(False))
    return joined.select("split", "w", F.when(has, F.lit("comp")).otherwise(F.lit("threat")).alias("target"),
                         F.when(has, F.col("comp")).otherwise(F.col("threat")).alias("score"),
                         F.when(has, F.col("y_within_K")).otherwise(F.col("y_attack_within_K")).alias("y"))


# --- E21 --------------------------------------------------------------------------------------------------

def hashed_start(seed: int = 42) -> Column:
    return F.pmod(F.xxhash64("split", "b", "j", F.lit(seed)), F.col("n") - F.col("block") + 1)


def block_bootstrap(scored: DataFrame, block: int = 20, n_boot: int = 2000, start: Column | None = None,
                    score_cols: tuple[str, ...] = ("score",)) -> DataFrame:
    """Per resample ROC-AUC of every score column on the *same* moving-block resamples: (split, series, b, roc_auc).

    Only the block starts are drawn; their windows are looked up by an equi-join on (split, w), and a window
    drawn m times carries weight m.
    """
    start = hashed_start() if start is None else start
    sizes = scored.groupBy("split").agg(F.count("*").alias("n")).withColumn("block", F.least(F.lit(block).cast("long"), F.col("n")))
    blocks = F.ceil(F.col("n") / F.col("block"))
    drawn = (sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
             .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .withColumn("start", start))
    taken = F.least(F.col("block"), F.col("n") - F.col("j") * F.col("block"))  # the last block may be cut short
    picks = (drawn.select("split", "b", F.explode(F.sequence(F.col("start"), F.col("start") + taken - 1)).alias("w"))
             .groupBy("split", "b", "w").agg(F.count("*").alias("m")))
    position = scored.withColumn("_w", F.row_number().over(Window.partitionBy("split").orderBy("w")).cast("long") - 1)
    series = position.select("split", F.col("_w").alias("w"), "y", *score_cols)
    rows = picks.join(series, ["split", "w"])
    rows = rows.unpivot(["split", "b", "w", "m", "y"], list(score_cols), "series", "value")
    group = ["split", "series", "b"]
    t = F.col("y").cast("int") == 1
    counted = rows.groupBy(*group, "value").agg(
        F.sum(F.when(t, F.col("m")).otherwise(0)).alias("pos"), F.sum(F.when(t, 0).otherwise(F.col("m"))).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    wins = counted.withColumn("win", F.col("pos") * (below + F.col("neg") / 2))
    return wins.groupBy(*group).agg(
        F.try_divide(F.sum("win"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def bootstrap_interval(resamples: DataFrame) -> DataFrame:
    """Percentile 95 % interval per series; single-class resamples are dropped and counted."""
    return resamples.groupBy("split", "series").agg(
        F.percentile("roc_auc", 0.025).alias("lo"), F.percentile("roc_auc", 0.975).alias("hi"),
        F.count_if(F.col("roc_auc").isNull()).alias("dropped"))


def paired_differences(resamples: DataFrame, a: str, b: str) -> DataFrame:
    """Interval of the per-resample difference between two series."""
    wide = resamples.groupBy("split", "b").agg(
        F.max(F.when(F.col("series") == a, F.col("roc_auc"))).alias("x"),
        F.max(F.when(F.col("series") == b, F.col("roc_auc"))).alias("y")).withColumn("d", F.col("x") - F.col("y"))
    return wide.groupBy("split").agg(F.avg("d").alias("mean_difference"), F.percentile("d", 0.025).alias("lo"),
                                     F.percentile("d", 0.975).alias("hi"))


# --- E22, E23 ---------------------------------------------------------------------------------------------

def _tenth(p: Column) -> Column:
    edges = [i * 0.1 for i in range(1, 10)]
    return F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= p))


def reliability(scored: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Ten equal-width bins with mean forecast and observed rate."""
    return scored.withColumn("bin", _tenth(F.col("score"))).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"))


def calibration(scored: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Base rate, mean forecast, Brier, Brier of the base rate, expected calibration error."""
    y = F.col("y").cast("double")
    gap = reliability(scored, keys).groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))
    base = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg("score").alias("mean_forecast"),
        F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"), F.var_pop(y).alias("brier_base_rate"))
    return base.join(gap, list(keys))


EPS = 1e-7


def _logit(p: Column, eps: float = EPS) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def rescale(p: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-_logit(p) / F.lit(float(temperature))))


def fit_temperature(scored: DataFrame, rounds: int = 4, points: int = 41) -> float:
    """The temperature with the lowest log loss, on a log grid refined around its best point.

    Each round is one pass that returns ``points`` averages, so only those numbers reach the driver.
    """
    low, high = -5.0, 5.0
    rows = scored.select(_logit(F.col("score")).alias("z"), F.col("y").cast("double").alias("y")).persist()
    best = 0.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        losses = []
        for i, log_t in enumerate(grid):
            q = 1 / (1 + F.exp(-F.col("z") / F.lit(math.exp(log_t))))
            q = F.greatest(F.least(q, F.lit(1 - EPS)), F.lit(EPS))
            losses.append(F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias(f"l{i}"))
        found = rows.agg(*losses).first()
        at = min(range(points), key=lambda i: found[i])
        best, width = grid[at], (high - low) / (points - 1)
        low, high = best - width, best + width
    rows.unpersist()
    return math.exp(best)


def temperature_scaled(scored: DataFrame, temperature: float) -> DataFrame:
    return scored.withColumn("score", rescale(F.col("score"), temperature))


# --- E24 --------------------------------------------------------------------------------------------------

def stage_confusion(predicted: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Every (true, predicted) stage cell, empty ones included, from (keys, stage, pred_stage)."""
    cells = predicted.groupBy(*keys, "stage", "pred_stage").agg(F.count("*").alias("windows"))
    stage_ids = F.sequence(F.lit(0), F.lit(len(STAGES) - 1))
    full = (predicted.select(*keys).distinct().withColumn("stage", F.explode(stage_ids))
            .withColumn("pred_stage", F.explode(stage_ids)))
    return full.join(cells, [*keys, "stage", "pred_stage"], "left").fillna(0, ["windows"])


def per_stage(cells: DataFrame, keys: tuple[str, ...] = ("split",), merge_discovery: bool = False) -> DataFrame:
    """Support, predicted, precision, recall per stage (null on empty); the technique view merges two stages."""
    def name(col: str) -> Column:
        merged = F.when(F.col(col) == 3, F.lit(1)).otherwise(F.col(col)) if merge_discovery else F.col(col)
        return merged.cast("int")

    rows = cells.select(*keys, name("stage").alias("t"), name("pred_stage").alias("p"), "windows")
    sides = rows.select(*keys, "windows", (F.col("t") == F.col("p")).alias("hit"), F.explode(F.array(
        F.struct(F.col("t").alias("stage"), F.lit(True).alias("truth")),
        F.struct(F.col("p").alias("stage"), F.lit(False).alias("truth")))).alias("s")).select(*keys, "windows", "hit", "s.*")
    out = sides.groupBy(*keys, "stage").agg(
        F.sum(F.when(F.col("truth"), F.col("windows")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("truth"), F.col("windows")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("truth") & F.col("hit"), F.col("windows")).otherwise(0)).alias("hits"))
    return out.select(*keys, "stage", "support", "predicted", F.try_divide("hits", "predicted").alias("precision"),
                      F.try_divide("hits", "support").alias("recall"))


def stage_summary(predicted: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Accuracy, accuracy and detection on hostile windows, false stages on benign ones."""
    t, p = F.col("stage"), F.col("pred_stage")
    return predicted.groupBy(*keys).agg(
        F.avg((t == p).cast("int")).alias("accuracy"), F.count_if(t > 0).alias("hostile_windows"),
        F.avg(F.when(t > 0, (t == p).cast("int"))).alias("hostile_stage_accuracy"),
        F.avg(F.when(t > 0, (p > 0).cast("int"))).alias("hostile_detected"),
        F.avg(F.when(t == 0, (p > 0).cast("int"))).alias("benign_false_stage"))


# --- E25-E31 ----------------------------------------------------------------------------------------------

def effect_sizes(rows: DataFrame, features: list[str], group: Column, keys: tuple[str, ...] = ("split",),
                 pooled: str = "cohen") -> DataFrame:
    """Standardised mean difference per feature, ``group`` true minus false (null group left out).

    ``cohen`` pools sample variances by size; ``smd`` averages population variances. All features are aggregated
    in one wide row per key and unpivoted afterwards, so rows are never multiplied by features.
    """
    var = F.var_samp if pooled == "cohen" else F.var_pop
    marked = rows.withColumn("_g", group)
    aggs = [F.count_if(F.col("_g")).alias("na"), F.count_if(~F.col("_g")).alias("nb")]
    for f in features:
        a, b = F.when(F.col("_g"), F.col(f)), F.when(~F.col("_g"), F.col(f))
        aggs.append(F.struct(F.avg(a).alias("ma"), F.avg(b).alias("mb"), var(a).alias("va"), var(b).alias("vb")).alias(f"f_{f}"))
    wide = marked.groupBy(*keys).agg(*aggs)
    tall = wide.select(*keys, "na", "nb", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"f_{f}").alias("m"))
                                                            for f in features))).alias("x")).select(*keys, "na", "nb", "x.feature", "x.m.*")
    diff = F.col("ma") - F.col("mb")
    if pooled == "cohen":
        sd = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
        d = F.when(sd >= 1e-9, diff / sd)
    else:
        sd = F.sqrt((F.col("va") + F.col("vb")) / 2)
        d = F.when(sd > 1e-9, diff / sd).otherwise(F.lit(0.0))
    return tall.select(*keys, "feature", d.alias("d"))


def top_effects(effects: DataFrame, k: int = 10, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("d")), "feature")
    return effects.where(F.col("d").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def background_windows(states: DataFrame, gap: int = 30) -> DataFrame:
    """Adds ``background``: no attack window t with w in [t - gap, t + gap)."""
    from tidewatch.operators.series import along
    near = F.max(F.col("attack_now")).over(along().rowsBetween(-(gap - 1), gap))
    return states.withColumn("background", near == 0)


def direction_flips(train: DataFrame, held: DataFrame, at_least: float = 0.2, keys: tuple[str, ...] = ("split",),
                    per: tuple[str, ...] = ()) -> DataFrame:
    """Features whose effect changes sign between training and held-out data, both sizable.

    Both sides share ``keys``; ``per`` tells several held-out sets apart, each against the same training data.
    """
    a = train.select(*keys, "feature", F.col("d").alias("d_train"))
    b = held.select(*keys, *per, "feature", F.col("d").alias("d_held"))
    flips = ((F.signum("d_train") != F.signum("d_held")) & (F.abs("d_train") >= at_least) & (F.abs("d_held") >= at_least))
    return a.join(b, [*keys, "feature"]).withColumn("flips", F.coalesce(flips, F.lit(False)))


def signature_hits(ranking: DataFrame, signature: DataFrame, n_features: int, top: int = 8,
                   keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Overlap of the top of a ranking (keys, feature, rank) with a signature (keys, feature), and P(X >= hits)."""
    wanted = signature.select(*keys, "feature").distinct()
    sizes = wanted.groupBy(*keys).agg(F.count("*").alias("size"))
    hits = (ranking.where(F.col("rank") <= top).join(wanted, [*keys, "feature"], "left_semi")
            .groupBy(*keys).agg(F.count("*").alias("hits")))
    table = sizes.join(hits, list(keys), "left").fillna(0, ["hits"])

    def choose(n: Column, k: Column) -> Column:
        return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
                           F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)

    size, n, k = F.col("size"), F.lit(n_features).cast("long"), F.lit(top).cast("long")
    # hits <= x <= min(top, size); fewer misses than exist outside the signature is impossible
    xs = F.sequence(F.col("hits").cast("long"), F.least(size, k))
    tail = F.aggregate(F.filter(xs, lambda x: (k - x) <= (n - size)), F.lit(0.0),
                       lambda acc, x: acc + choose(size, x) * choose(n - size, k - x) / choose(n, k))
    return table.withColumn("p_value", tail)


def evenly_spaced(rows: DataFrame, keys: tuple[str, ...], most: int = 24) -> DataFrame:
    """At most ``most`` rows of each group at evenly spaced positions along ``w``."""
    group = Window.partitionBy(*keys)
    placed = rows.withColumns({"_i": F.row_number().over(group.orderBy("w")) - 1, "_n": F.count("*").over(group)})
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    positions = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * step).cast("int"))
    keep = (F.col("_n") <= most) | F.array_contains(positions, F.col("_i"))
    return placed.where(keep).drop("_i", "_n")


def average_ranks(df: DataFrame, keys: tuple[str, ...], value: str, name: str) -> DataFrame:
    """Average-tie ranks inside groups of any size: equal values are counted, then ranked once."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running_totals(counted, list(keys), value, ["_c"])
    ranks = ranked.select(*keys, value, (F.col("cum__c") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    """Correlation of average ranks."""
    ranked = average_ranks(average_ranks(df.select(*keys, a, b), keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"))


# --- E34, E35 ---------------------------------------------------------------------------------------------

def score_distribution(scored: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Count, mean and quantiles 0, 10, 50, 90, 95, 99, 100 %."""
    wanted = {f"q{int(q * 100)}": q for q in (0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0)}
    base = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return base.join(grouped_quantiles(scored, list(keys), "score", wanted), list(keys))


def interval_summary(alarms: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Alarmed share overall, on attack and on benign windows; medians; from (split, w, score, alarm, stage)."""
    hot, attack = F.col("alarm").cast("int"), F.col("stage") > 0
    return alarms.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if(attack).alias("attack_windows"), F.sum(hot).alias("alarmed_windows"),
        F.avg(hot).alias("alarmed_share"), F.count_if(attack & F.col("alarm")).alias("alarmed_on_attack"),
        F.count_if(~attack & F.col("alarm")).alias("alarmed_on_benign"),
        F.avg(F.when(attack, hot)).alias("attack_alarmed_share"), F.percentile("score", 0.5).alias("score_median"),
        F.max("score").alias("score_max"), F.percentile(F.when(~attack, F.col("score")), 0.5).alias("benign_median"))


def between_times(alarms: DataFrame, lo: Column, hi: Column, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """The same statistics inside a time interval, with the strongest alarm's time."""
    inside = alarms.where((F.col("ts") >= lo) & (F.col("ts") <= hi))
    return inside.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if("alarm").alias("alarmed"), F.min("score").alias("score_min"),
        F.percentile("score", 0.5).alias("score_median"), F.max("score").alias("score_max"),
        F.max_by(F.when(F.col("alarm"), F.col("ts")), F.when(F.col("alarm"), F.struct("score", (-F.unix_micros("ts")).alias("t")))).alias("peak_ts"))


def first_alarm_after(alarms: DataFrame, runs: DataFrame, onset_table: DataFrame, stride_s: float) -> DataFrame:
    """Per split, the first alarm run still up at or after the first onset, and minutes late."""
    first = onset_table.groupBy("split").agg(F.min("onset_w").alias("onset_w"))
    live = runs.drop("onset_w").join(first, "split").where(F.col("end_w") >= F.col("onset_w"))
    start = live.groupBy("split").agg(F.min("begin_w").alias("first_alarm_w"))
    late = (F.col("first_alarm_w") - F.col("onset_w")) * F.lit(stride_s / 60.0)
    return first.join(start, "split", "left").withColumn("minutes_late", late)
