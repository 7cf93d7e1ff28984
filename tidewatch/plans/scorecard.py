"""Evaluation of stored scores, end to end (E16), and single-feature floors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alerts, episodes, metrics, targets
from tidewatch.schema import HORIZON
from tidewatch.session import cut_lineage


def split_roles(states: DataFrame) -> DataFrame:
    """(split, attack_role, compromise_role): has a non-impact attack onset; has a compromise onset."""
    attack = targets.without_family(targets.episode_onsets(states, "attack"), "IMPACT").select("split").distinct()
    comp = targets.episode_onsets(states, "compromise").select("split").distinct()
    roles = states.select("split").distinct()
    return (roles.join(attack.withColumn("attack_role", F.lit(True)), "split", "left")
            .join(comp.withColumn("compromise_role", F.lit(True)), "split", "left").fillna(False))


def scorecard(scores: DataFrame, states: DataFrame, horizon: int = HORIZON, n_shifts: int = 2000,
              quantile: float = 0.90) -> DataFrame:
    """One row per (run, seed) with the S1-S4 numbers.

    ``scores(run, seed, split, w, channel, score)`` with channels comp and threat; ``states(split, w, stage,
    y_within_K)``. Pooled figures add counts over splits before taking ratios.
    """
    who = ("run", "seed")
    # both tables feed a dozen small aggregates: written once, so none of them repeats the work behind it
    states = cut_lineage(states.select("split", "w", "stage", "y_within_K"))
    roles = split_roles(states)
    labels = states.select("split", "w", "stage", F.col("y_within_K").alias("y"), (F.col("stage") == 0).alias("eligible"))
    everything = scores.join(labels, ["split", "w"]).join(roles, "split")
    alarms = cut_lineage(alerts.causal_threshold(everything, quantile, keys=(*who, "channel")))

    comp = alarms.where((F.col("channel") == "comp") & F.col("compromise_role"))
    s1 = metrics.confusion(comp, who).select(*who, F.col("precision").alias("s1_precision"), F.col("fpr").alias("s1_fpr"))
    comp_pr = (metrics.ranking_metrics(comp, (*who, "split")).groupBy(*who).agg(F.avg("pr_auc").alias("comp_pr_auc")))

    attack_onsets = targets.episode_onsets(states, "attack")
    counted = targets.without_family(attack_onsets, "IMPACT")
    threat = alarms.where((F.col("channel") == "threat") & F.col("attack_role"))
    # (run, seed) is folded into the split key: a run's series is ranked and rotated on its own
    own, back = _own_split(threat, who)
    per_run_onsets = _spread(counted, threat, who)
    all_onsets = _spread(attack_onsets, threat, who)
    cells = back(episodes.lead_bin_percentiles(own, per_run_onsets, all_onsets))
    s2 = cells.groupBy(*who).pivot("bin", list(episodes.LEAD_BINS)).agg(F.avg("percentile"))
    gating = [F.col(f"`{b}`") for b in episodes.GATING_BINS]
    s2 = s2.withColumn("s2_star", sum(gating[1:], gating[0]) / len(gating))

    day = (cells.where(F.col("bin").isin(*episodes.GATING_BINS)).groupBy(*who, "split", "bin").agg(F.avg("percentile").alias("p"))
           .groupBy(*who, "split").agg(F.avg("p").alias("day_mean")))
    s4 = day.groupBy(*who).agg(F.min("day_mean").alias("s4_worst_split"))

    quiet = targets.quiet_before(states, counted).where(F.col("quiet_windows") >= episodes.REFERENCE_GAP).select("split", "onset_w")
    lonely = cells.join(quiet, ["split", "onset_w"], "left_semi").where(F.col("bin").isin(*episodes.GATING_BINS))
    lonely = (lonely.groupBy(*who, "bin").agg(F.avg("percentile").alias("p")).groupBy(*who).agg(F.avg("p").alias("s2_star_isolated")))

    null = back(episodes.circular_shift_null(own, per_run_onsets, horizon, 2, n_shifts))
    leads = back(episodes.strict_lead_times(own, per_run_onsets, horizon))
    s3 = leads.groupBy(*who).agg(F.count_if("detected_early").alias("s3_warned"), F.count("*").alias("s3_episodes"))
    above = null.groupBy(*who).agg(F.count_if("exceeds_p95").alias("s3_above_p95"))
    fisher = episodes.fisher_combine(null, who).select(*who, F.col("p_combined").alias("s3_fisher_p"))

    out = scores.select(*who).distinct()
    for part in (s1, comp_pr, s2, s4, lonely, s3, above, fisher):
        out = out.join(part, list(who), "left")
    return out.withColumn("s3_passes", (F.col("s3_fisher_p") < 0.05) & (F.col("s3_above_p95") >= 2))


_JOINT = "\u001f"


def _own_split(rows: DataFrame, who: tuple[str, ...]):
    """Rows keyed by a joint split (split + run + seed), and the way back."""
    joint = F.concat_ws(_JOINT, "split", *(F.col(c).cast("string") for c in who))
    kinds = {c: dict(rows.dtypes)[c] for c in who}

    def back(table: DataFrame) -> DataFrame:
        parts = F.split("split", _JOINT)
        keyed = table.withColumns({c: parts[i + 1].cast(kinds[c]) for i, c in enumerate(who)})
        return keyed.withColumn("split", parts[0])

    return rows.withColumn("split", joint).drop(*who), back


def _spread(onset_table: DataFrame, rows: DataFrame, who: tuple[str, ...]) -> DataFrame:
    """Onsets repeated for each run that scored their split (an equi-join on split)."""
    runs = rows.select("split", *who).distinct()
    joint = F.concat_ws(_JOINT, "split", *(F.col(c).cast("string") for c in who))
    return onset_table.join(runs, "split").withColumn("split", joint).drop(*who)


def feature_floors(scored: DataFrame, features: list[str], budgets: tuple[int, ...] = (10, 5, 2)) -> DataFrame:
    """Each raw column scored as an alarm at fixed budgets of its own capture's quantile."""
    tall = scored.unpivot(["split", "w", "y"], features, "feature", "score")
    levels = tall.groupBy("feature", "split").agg(
        F.percentile("score", F.array(*(F.lit(1 - b / 100.0) for b in budgets))).alias("levels"))
    lines = levels.select("feature", "split", F.posexplode("levels").alias("_i", "threshold")).withColumn(
        "budget", F.element_at(F.array(*(F.lit(b) for b in budgets)), F.col("_i") + 1)).drop("_i")
    alarms = tall.join(lines, ["feature", "split"]).withColumn("alarm", F.col("score") >= F.col("threshold"))
    return metrics.confusion(alarms, ("feature", "budget", "split"))
