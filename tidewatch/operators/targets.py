"""Look-ahead targets, episodes and training sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import is_attack, is_compromise, progression
from tidewatch.operators.series import ahead, along
from tidewatch.schema import COMPROMISE_FROM, HORIZON, IMPACT, STAGES, STAGE_TITLES

ONSET_GAP = 4


def ahead_at(flag: Column, k: int) -> Column:
    """The flag ``k`` windows later; 0 past the end of the split."""
    return F.coalesce(F.lead(flag.cast("int"), k).over(along()), F.lit(0))


def any_ahead(flag: Column, horizon: int) -> Column:
    """Whether the flag is up at least once in (w, w + horizon]."""
    return F.coalesce(F.max(flag.cast("int")).over(ahead(horizon)), F.lit(0))


def with_targets(stages: DataFrame, horizon: int = HORIZON, threshold: int = COMPROMISE_FROM) -> DataFrame:
    """Every look-ahead column, from ``stage`` alone."""
    stage, prog = F.col("stage"), progression(F.col("stage"))
    comp, attack = is_compromise(stage, threshold), is_attack(stage)
    step = F.coalesce((prog > F.lag(prog).over(along())).cast("int"), F.lit(0))
    flagged = stages.withColumns({
        "compromise": comp.cast("int"), "attack_now": attack.cast("int"), "escalate_step": step})
    later = {f"hazard_k{k}": ahead_at(comp, k) for k in range(1, horizon + 1)}
    later |= {f"attack_k{k}": ahead_at(attack, k) for k in range(1, horizon + 1)}
    later |= {f"escalate_k{k}": F.coalesce((F.lead(prog, k).over(along()) > prog).cast("int"), F.lit(0))
              for k in range(1, horizon + 1)}
    later |= {"y_within_K": any_ahead(comp, horizon), "y_attack_within_K": any_ahead(attack, horizon),
              "y_escalate_within_K": any_ahead(F.col("escalate_step"), horizon)}
    return flagged.withColumns(later)


def masked_within(states: DataFrame, flag: str, horizon: int = HORIZON) -> DataFrame:
    """The within-horizon target plus a mask of windows that have a full future."""
    size = F.count("*").over(Window.partitionBy("split"))
    return states.withColumns({
        "target": any_ahead(F.col(flag) > 0, horizon), "full_future": F.col("w") < size - horizon})


def onsets(states: DataFrame, flag: Column, gap: int = ONSET_GAP) -> DataFrame:
    """First window of every run of flagged windows, runs more than ``gap`` apart: (split, onset_w, stage)."""
    since = F.col("w") - F.lag("w").over(along())
    return (states.where(flag).withColumn("since", since)
            .where(F.col("since").isNull() | (F.col("since") > gap))
            .select("split", F.col("w").alias("onset_w"), "stage"))


def stage_name(stage: Column, names=STAGES) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), stage.cast("int") + 1)


def episode_onsets(states: DataFrame, source: str = "attack", gap: int = ONSET_GAP,
                   threshold: int = COMPROMISE_FROM) -> DataFrame:
    """T7 + T8 families: (split, onset_w, stage, family) keyed on any attack or on compromise."""
    if source not in ("attack", "compromise"):
        raise ValueError(f"onset source must be 'attack' or 'compromise', got {source!r}")
    stage = F.col("stage")
    flag = is_attack(stage) if source == "attack" else is_compromise(stage, threshold)
    return onsets(states, flag, gap).withColumn("family", stage_name(stage))


def without_family(onset_table: DataFrame, family: str) -> DataFrame:
    """T9."""
    return onset_table.where(F.col("family") != family)


def episode_labels(states: DataFrame, horizon: int = HORIZON, gap: int = ONSET_GAP, source: str = "attack") -> DataFrame:
    """Per window ``onset_now``, ``precursor`` (quiet, an onset within the horizon) and ``eligible``."""
    stage = F.col("stage")
    flag = is_attack(stage) if source == "attack" else is_compromise(stage)
    # the previous flagged window is the newest flagged w before this one
    last = F.max(F.when(flag, F.col("w"))).over(along().rowsBetween(Window.unboundedPreceding, -1))
    marked = states.withColumn("_last", last)
    first = flag & (F.col("_last").isNull() | (F.col("w") - F.col("_last") > gap))
    marked = marked.withColumn("onset_now", first.cast("int"))
    precursor = (any_ahead(F.col("onset_now"), horizon) > 0) & ~is_attack(stage)
    return marked.withColumns({"precursor": precursor.cast("int"), "eligible": ~is_attack(stage)}).drop("_last")


def quiet_before(states: DataFrame, onset_table: DataFrame) -> DataFrame:
    """Quiet windows between the previous attack window (or the capture's start) and each onset."""
    last = F.max(F.when(is_attack(F.col("stage")), F.col("w"))).over(along().rowsBetween(Window.unboundedPreceding, -1))
    quiet = states.select("split", F.col("w").alias("onset_w"),
                          F.coalesce(F.col("w") - last - 1, F.col("w")).alias("quiet_windows"))
    return onset_table.join(quiet, ["split", "onset_w"])


def stage_spans(stages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Runs of one non-benign stage, named by the commonest non-attempted attack label inside.

    ``labelled(split, w, label, c)`` holds attack-label counts per window (see ``window_label_counts``): counts,
    not flows, so finding a span's label is an equi-join of two small tables.
    """
    change = F.coalesce(F.col("stage") != F.lag("stage").over(along()), F.lit(True)).cast("int")
    marked = stages.select("split", "w", "stage", change.alias("_c"))
    runs = marked.withColumn("run", F.sum("_c").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    members = runs.where(F.col("stage") > 0)
    spans = members.groupBy("split", "run", "stage").agg(F.min("w").alias("start_w"), F.max("w").alias("end_w"))
    title = stage_name(F.col("stage"), STAGE_TITLES)
    if labelled is None:
        return spans.select("split", "start_w", "end_w", "stage", title.alias("label"))
    totals = (members.select("split", "w", "run").join(labelled, ["split", "w"])
              .groupBy("split", "run", "label").agg(F.sum("c").alias("c")))
    best = totals.groupBy("split", "run").agg(F.min_by("label", F.struct((-F.col("c")).alias("c"), "label")).alias("best"))
    return (spans.join(best, ["split", "run"], "left")
            .select("split", "start_w", "end_w", "stage", F.coalesce("best", title).alias("label")))


def window_label_counts(flows: DataFrame, grid) -> DataFrame:
    """Attack labels per window with their flow counts, attempted flows left out."""
    attacks = flows.where((F.col("stage") > 0) & ~F.coalesce(F.col("attempted"), F.lit(False)))
    sliced = (grid.locate(attacks.select("split", "ts", "label"))
              .groupBy("split", "slice_no", "n", "label").agg(F.count("*").alias("c")))
    return grid.to_windows(sliced).groupBy("split", "w", "label").agg(F.sum("c").alias("c"))


def sliding_sequences(states: DataFrame, features: list[str], seq_len: int, stride: int) -> DataFrame:
    """(split, start_w, seq): every full run of ``seq_len`` windows starting at a multiple of ``stride``."""
    span = along().rowsBetween(0, seq_len - 1)
    item = F.struct("w", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), "stage")
    rows = states.withColumns({"_k": F.count("*").over(span), "seq": F.collect_list(item).over(span)})
    return rows.where((F.col("_k") == seq_len) & (F.col("w") % stride == 0)).select(
        "split", F.col("w").alias("start_w"), "seq")


def onset_sequences(states: DataFrame, onset_table: DataFrame, features: list[str], offsets: list[int],
                    history: int, horizon: int) -> DataFrame:
    """Histories ending ``offset`` windows before an onset, followed by the horizon; out-of-range dropped."""
    length = history + horizon
    span = along().rowsBetween(0, length - 1)
    item = F.struct("w", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), "stage")
    rows = states.withColumns({"_k": F.count("*").over(span), "seq": F.collect_list(item).over(span)})
    full = rows.where(F.col("_k") == length).select("split", F.col("w").alias("start_w"), "seq")
    starts = onset_table.select("split", "onset_w", F.explode(F.array(*(F.lit(o) for o in offsets))).alias("offset"))
    starts = starts.withColumn("start_w", F.col("onset_w") - F.col("offset") - (history - 1))
    return starts.join(full, ["split", "start_w"]).select("split", "onset_w", "offset", "start_w", "seq")


def stage_weights(states: DataFrame) -> DataFrame:
    """Inverse-frequency stage weights, scaled to mean 1 over the stages present."""
    counts = states.groupBy("stage").agg(F.count("*").alias("windows"))
    everything = Window.partitionBy(F.lit(1))  # at most seven rows
    raw = F.sum("windows").over(everything) / F.col("windows")
    return counts.withColumn("raw", raw).select(
        "stage", "windows", (F.col("raw") / F.avg("raw").over(everything)).alias("weight"))


def positive_weights(states: DataFrame, columns: list[str], caps: dict[str, float] | None = None,
                     default_cap: float = 50.0) -> DataFrame:
    """Negatives per positive for each binary column, capped."""
    caps = caps or {"onset_now": 250.0}
    n = F.count("*")
    total = states.agg(n.alias("n"), *(F.greatest(F.sum(c).cast("double"), F.lit(1.0)).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.least(
        (F.col("n") - F.col(c)) / F.col(c), F.lit(float(caps.get(c, default_cap)))).alias("pos_weight")) for c in columns))
    return total.select(F.explode(pairs).alias("p")).select("p.*")


def split_metadata(states: DataFrame, flows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Per split the anchor, flow and window counts, positives, rates, onsets and stage counts."""
    counted = flows.groupBy("split").agg(F.count("*").alias("flows"))
    per = states.groupBy("split").agg(
        F.min("ts").alias("t0"), F.count("*").alias("windows"), F.sum("y_within_K").alias("positives"),
        F.avg("y_within_K").alias("positive_rate"), F.avg("attack_now").alias("attack_rate"),
        *(F.count_if(F.col("stage") == s).alias(f"windows_{name}") for s, name in enumerate(STAGES)))
    first = episode_onsets(states, "compromise").groupBy("split").agg(
        F.sort_array(F.collect_list("onset_w")).alias("onsets"))
    return (per.join(counted, "split", "left").join(first, "split", "left")
            .withColumn("onsets", F.coalesce("onsets", F.array().cast("array<bigint>"))))
