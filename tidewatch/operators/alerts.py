"""Alert thresholds and alarms (E1-E3, E8, E9). ``scores`` is (split, w, score, ...), one row per window."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.quantiles import range_pieces, running_totals
from tidewatch.operators.ordered import Counted
from tidewatch.operators.series import along
from tidewatch.session import cut_lineage

WARMUP = 20
#: windows of a series that one task walks
BLOCK = 4096
#: ranks that are looked up together
STRIP = 1024


def causal_threshold(scores: DataFrame, quantile: float = 0.90, warmup: int = WARMUP, trailing: int | None = None,
                     keys: tuple[str, ...] = (), grouped: bool | None = None) -> DataFrame:
    """Adds ``threshold`` and ``alarm``, from windows strictly before each one.

    The threshold is null (no alarm possible) for the first ``warmup`` windows. A trailing threshold has a
    bounded frame and is a plain window function, and so is the expanding one on demand (``grouped=False``); by
    default it is taken block by block with counted values, by many tasks a series.
    """
    if grouped is None:
        grouped = trailing is None
    if grouped and trailing is None:
        out = _expanding(scores, quantile, keys)
    else:
        start = Window.unboundedPreceding if trailing is None else -trailing
        frame = along(*keys).rowsBetween(start, -1)
        out = scores.withColumn("_t", F.row_number().over(along(*keys)) - 1).withColumn("threshold", F.percentile("score", quantile).over(frame))
    ready = F.when(F.col("_t") >= warmup, F.col("threshold"))
    return (out.withColumn("threshold", ready).drop("_t")
            .withColumn("alarm", alarm_flag(F.col("score"), F.col("threshold"))))


def alarm_flag(score: Column, threshold: Column) -> Column:
    return F.coalesce(score >= threshold, F.lit(False))


def _expanding(scores: DataFrame, quantile: float, keys: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """``scores`` with ``threshold``, the quantile of all scores before each one in its series, by blocks of windows.

    While a block of ``block`` windows is walked, the quantile moves by at most that many ranks, so besides its own scores a task
    needs only the ranks of the past around the place where the quantile stands when the block begins, and how many lie
    below them. Values are dealt into pieces by size; counts per (block, piece), carried along the blocks, tell which pieces hold
    those ranks. So a task holds some ``block`` values, whatever the length of the series, and no task holds a whole one.
    """
    group = [*keys, "split"]
    rows = scores.withColumn("_t", F.row_number().over(along(*keys)) - 1).withColumn("_block", F.floor(F.col("_t") / block).cast("int"))
    rows = cut_lineage(rows)
    values = range_pieces(rows.select(*group, "score", "_block"), group, "score")
    counts = values.groupBy(*group, "_piece", "_block").agg(F.count("*").alias("_c"))
    # how many of the past lie in each piece when a block begins, and below it
    spans = counts.groupBy(*group).agg(F.max("_block").alias("_blocks")).where("_blocks > 0")
    grid = counts.select(*group, "_piece").distinct().join(spans, group).withColumn("_block", F.explode(F.sequence(F.lit(1), F.col("_blocks"))))
    past = grid.join(counts.withColumn("_block", F.col("_block") + 1), [*group, "_piece", "_block"], "left").fillna(0, ["_c"])
    past = past.withColumn("_held", F.sum("_c").over(Window.partitionBy(*group, "_piece").orderBy("_block")))
    below = Window.partitionBy(*group, "_block").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    past = past.withColumn("_below", F.coalesce(F.sum("_held").over(below), F.lit(0)))
    n = F.col("_block").cast("long") * block
    needed = past.where((F.col("_below") <= F.ceil(F.lit(quantile) * (n + block))) & (F.col("_below") + F.col("_held") > F.floor(F.lit(quantile) * (n - 1)) - block))
    near = (needed.select(*group, "_piece", "_block", "_below").join(values.withColumnRenamed("_block", "_own"), [*group, "_piece"])
            .where("_own < _block").select(*group, "_block", "score", "_below"))

    names, at = scores.columns, [*scores.columns].index("score")

    def walk(table: pa.Table) -> pa.Table:
        is_near = pc.is_valid(table.column("_below"))
        known = table.filter(is_near)
        own = table.filter(pc.invert(is_near)).sort_by("_t")
        held = Counted()
        hidden = pc.min(known.column("_below")).as_py() if known.num_rows else 0
        held.extend_sorted(sorted(known.column("score").to_pylist()))
        lowest = held.lows[0] if held.lows else None
        out = []
        for total, value in zip(own.column("_t").to_pylist(), own.column(at).to_pylist()):
            out.append(held.quantile(quantile, hidden, total))
            if hidden and value < lowest:
                hidden += 1  # it lies among values that no rank of this block reaches
            else:
                held.insert(value)
        return own.select([*names, "_t"]).append_column("threshold", pa.array(out, pa.float64()))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "_t"]) + ", threshold double"
    both = rows.withColumn("_below", F.lit(None).cast("long")).unionByName(near, allowMissingColumns=True)
    return both.groupBy(*group, "_block").applyInArrow(walk, schema)


def capture_threshold(scores: DataFrame, quantile: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """One threshold per split, the quantile of its whole capture."""
    level = scores.groupBy(*keys, "split").agg(F.percentile("score", quantile).alias("threshold"))
    return scores.join(level, [*keys, "split"]).withColumn("alarm", alarm_flag(F.col("score"), F.col("threshold")))


def training_threshold(scores: DataFrame, training: DataFrame, quantile: float) -> DataFrame:
    """The quantile of each held-out split's training scores; ``training(split, score)`` names the split it serves."""
    level = training.groupBy("split").agg(F.percentile("score", quantile).alias("threshold"))
    return scores.join(level, "split", "left").withColumn("alarm", alarm_flag(F.col("score"), F.col("threshold")))


def others_threshold(scores: DataFrame, quantile: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``training_threshold`` where each split is held out in turn: the quantile of all other splits' scores, ``(split, threshold)``.

    Ranks among the others are ranks among all, less the split's own values below. The split has n values, so the wanted rank lies at
    most n values further among all than among the others: each split looks at that stretch of the counted values only, and all
    splits together at about as many values as there are scores. A split without others gets no row.
    """
    group = [*keys, "split"]
    k = [*keys] or ["_all"]
    rows = scores.where("score is not null").select(*group, F.col("score").cast("double").alias("score")).withColumn("_all", F.lit(0))
    own = rows.groupBy(*dict.fromkeys([*k, *group]), "score").agg(F.count("*").alias("_own"))
    counted = own.groupBy(*k, "score").agg(F.sum("_own").alias("_c"))
    ranked = cut_lineage(running_totals(counted, k, "score", ["_c"]))
    total = ranked.groupBy(*k).agg(F.max("cum__c").alias("_total"))
    sizes = own.groupBy(*dict.fromkeys([*k, *group])).agg(F.sum("_own").alias("_n")).join(total, k).where("_total > _n")
    place = F.lit(float(quantile)) * (F.col("_total") - F.col("_n") - 1)
    # strips of STRIP ranks: a value lies in those its ranks touch, a split looks into those its stretch touches
    strip = lambda c: F.floor(c / STRIP)
    looked = sizes.withColumn("_low", F.floor(place)).withColumn("_strip", F.explode(F.sequence(strip(F.col("_low")), strip(F.ceil(place) + F.col("_n")))))
    strips = ranked.withColumn("_strip", F.explode(F.sequence(strip(F.col("cum__c") - F.col("_c")), strip(F.col("cum__c") - 1))))
    seen = looked.join(strips, [*k, "_strip"]).dropDuplicates([*dict.fromkeys([*k, *group]), "score"])
    seen = seen.join(own, [*dict.fromkeys([*k, *group]), "score"], "left").fillna(0, ["_own"])
    # the split's own values below the stretch, and along it
    first = seen.groupBy(*dict.fromkeys([*k, *group])).agg(F.min("score").alias("_first"))
    under = own.join(first, [*dict.fromkeys([*k, *group])]).where(F.col("score") < F.col("_first")).groupBy(*dict.fromkeys([*k, *group])).agg(F.sum("_own").alias("_under"))
    seen = seen.join(under, [*dict.fromkeys([*k, *group])], "left").fillna(0, ["_under"])
    mine = F.sum("_own").over(Window.partitionBy(*dict.fromkeys([*k, *group])).orderBy("score")) + F.col("_under")
    seen = seen.withColumn("_upto", F.col("cum__c") - mine)
    start = F.col("_upto") - (F.col("_c") - F.col("_own"))
    at = lambda r: F.max(F.when((start <= r) & (r < F.col("_upto")), F.col("score")))
    found = seen.groupBy(*dict.fromkeys([*k, *group]), "_total", "_n").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"))
    return found.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias("threshold"))


def fixed_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("threshold", F.lit(float(threshold))).withColumn(
        "alarm", alarm_flag(F.col("score"), F.col("threshold")))


def threshold_policies(scores: DataFrame, training: DataFrame | None = None, warmup: int = WARMUP, hold_out: bool = False) -> DataFrame:
    """The alert policies side by side: (policy, split, w, score, threshold, alarm, ...).

    The training quantile's policy takes ``training`` or, with ``hold_out``, all splits but the one judged.
    """
    made = {
        "whole-capture-10pct": capture_threshold(scores, 0.90),
        "expanding-10pct": causal_threshold(scores, 0.90, warmup),
        "trailing120-10pct": causal_threshold(scores, 0.90, warmup, trailing=120),
        "trailing60-10pct": causal_threshold(scores, 0.90, warmup, trailing=60),
        "expanding-5pct": causal_threshold(scores, 0.95, warmup),
    }
    if hold_out:
        level = others_threshold(scores, 0.95)
        made["train-quantile-5pct"] = scores.join(level, "split", "left").withColumn("alarm", alarm_flag(F.col("score"), F.col("threshold")))
    elif training is not None:
        made["train-quantile-5pct"] = training_threshold(scores, training, 0.95)
    stacked = None
    for name, table in made.items():
        one = table.withColumn("policy", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked


def alarm_rate(alarms: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Share of windows alarmed."""
    return alarms.groupBy(*keys).agg(F.count("*").alias("windows"), F.avg(F.col("alarm").cast("int")).alias("alarm_rate"))


def alarm_runs(alarms: DataFrame, onset_table: DataFrame | None, horizon: int, stride_s: float,
               persistence: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Contiguous alarmed windows, with the lead to the next onset within the horizon if sustained.

    The next onset at or after each window comes from a bounded frame ahead of it, so no range join is needed.
    """
    rows = alarms
    if onset_table is None:
        rows = rows.withColumn("_next", F.lit(None).cast("long"))
    else:
        marks = onset_table.select("split", F.col("onset_w").alias("w"), F.lit(True).alias("_onset"))
        rows = rows.join(marks, ["split", "w"], "left")
        frame = along(*keys).rowsBetween(0, horizon)
        rows = rows.withColumn("_next", F.min(F.when(F.col("_onset"), F.col("w"))).over(frame)).drop("_onset")
    hot = rows.where("alarm")
    island = F.col("w") - F.row_number().over(along(*keys))
    runs = hot.withColumn("_run", island).groupBy(*keys, "split", "_run").agg(
        F.min("w").alias("begin_w"), F.max("w").alias("end_w"), F.count("*").alias("windows"),
        F.max("score").alias("peak"), F.min_by("threshold", "w").alias("threshold"), F.min_by("_next", "w").alias("_next"))
    sustained = F.col("windows") >= persistence
    onset = F.when(sustained, F.col("_next"))
    return runs.select(
        *keys, "split", "begin_w", "end_w", "windows", sustained.alias("sustained"), "peak", "threshold",
        onset.alias("onset_w"), (onset - F.col("begin_w")).alias("lead_windows"),
        ((onset - F.col("begin_w")) * F.lit(float(stride_s))).alias("lead_seconds"))
