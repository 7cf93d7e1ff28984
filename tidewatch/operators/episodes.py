"""Early warning: lead times, their null, lead-bin percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import along
from tidewatch.session import cut_lineage

# --- fixed values: lead bins in windows before the onset ------------------------------------------------
LEAD_BINS = {"0-2min": (1, 4), "2-4min": (5, 8), "4-6min": (9, 12), "6-10min": (13, 20)}
GATING_BINS = ("2-4min", "4-6min", "6-10min")
REFERENCE_GAP = 20


def lead_times(alarms: DataFrame, onset_table: DataFrame, horizon: int, persistence: int = 1,
               confirm_before_onset: bool = False, use_eligible: bool = False,
               keys: tuple[str, ...] = ()) -> DataFrame:
    """Per onset, the first window of the horizon before it that starts ``persistence`` alarms in a row.

    Everything is a bounded frame around the onset's own row: whether a run starts at w looks ahead
    ``persistence`` rows, and the first such w looks back ``horizon`` rows.
    """
    alarm = F.col("alarm") & F.col("eligible") if use_eligible else F.col("alarm")
    run = along(*keys).rowsBetween(0, persistence - 1)
    starts = (F.min(F.col("_a").cast("int")).over(run) == 1) & (F.count("*").over(run) == persistence)
    latest = -persistence if confirm_before_onset else -1
    rows = alarms.withColumn("_a", alarm).withColumn("_start", starts)
    if latest >= -horizon:
        back = along(*keys).rowsBetween(-horizon, latest)
        first = F.min(F.when(F.col("_start"), F.col("w"))).over(back)
    else:
        first = F.lit(None).cast("long")
    horizon_rows = along(*keys).rowsBetween(-horizon, -1)
    allowed = F.count_if(F.col("eligible")) if "eligible" in alarms.columns else F.count("*")
    seen = rows.withColumns({"first_alarm": first, "eligible_windows": allowed.over(horizon_rows)})
    at = seen.select(*keys, "split", F.col("w").alias("onset_w"), "first_alarm", "eligible_windows",
                     F.col("score").alias("score_at_onset"))
    joined = onset_table.join(at, ["split", "onset_w"])
    return joined.withColumns({
        "lead_windows": F.coalesce(F.col("onset_w") - F.col("first_alarm"), F.lit(0).cast("long")),
        "detected_early": F.col("first_alarm").isNotNull()})


def strict_lead_times(alarms: DataFrame, onset_table: DataFrame, horizon: int, persistence: int = 2,
                      keys: tuple[str, ...] = ()) -> DataFrame:
    """Both guards on: only eligible windows count, and the run must be complete before the onset."""
    return lead_times(alarms, onset_table, horizon, persistence, True, True, keys)


def lead_summary(leads: DataFrame, stride_s: float, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """E12."""
    early = F.when(F.col("lead_windows") > 0, F.col("lead_windows"))
    return leads.groupBy(*keys).agg(
        F.count("*").alias("episodes"), F.count(early).alias("warned_early"),
        F.coalesce(F.avg(early), F.lit(0.0)).alias("mean_lead_windows"),
        F.coalesce(F.avg(early) * F.lit(float(stride_s)), F.lit(0.0)).alias("mean_lead_seconds"),
        F.max("lead_windows").alias("max_lead_windows"))


def hashed_shift(seed: int = 42) -> Column:
    """A reproducible random rotation in [min_shift, n - min_shift) for shift number ``i`` of a split."""
    span = F.col("n") - 2 * F.col("min_shift")
    return F.col("min_shift") + F.pmod(F.xxhash64("split", "i", F.lit(seed)), span)


def _run_places(alarms: DataFrame, persistence: int) -> DataFrame:
    """(split, n, w, allowed, gap): per window whether a run beginning there is eligible throughout and inside the series,
    and how many windows on, around the end if need be, the next run of alarms begins (null without one)."""
    run = along().rowsBetween(0, persistence - 1)
    eligible = F.coalesce(F.col("eligible"), F.lit(False)) if "eligible" in alarms.columns else F.lit(True)
    place = (F.row_number().over(along()) - 1).cast("bigint")
    rows = alarms.select("split", "w", F.coalesce("alarm", F.lit(False)).cast("int").alias("a"), eligible.cast("int").alias("e")).select(
        "split", place.alias("w"), "a", F.count("*").over(Window.partitionBy("split")).alias("n"),
        ((F.min("e").over(run) == 1) & (F.count("*").over(run) == persistence)).alias("allowed"))
    # a run may lie across the end: the first windows once more behind the last
    again = rows.where(F.col("w") < persistence - 1).withColumn("w", F.col("w") + F.col("n"))
    starts = F.when(F.min("a").over(run) == 1, F.col("w"))
    marked = rows.unionByName(again).withColumn("start", starts).where(F.col("w") < F.col("n"))
    following = F.min("start").over(along().rowsBetween(0, Window.unboundedFollowing))
    around = F.min("start").over(Window.partitionBy("split")) + F.col("n")
    return marked.select("split", "n", "w", "allowed", (F.coalesce(following, around) - F.col("w")).alias("gap"))


def circular_shift_null(alarms: DataFrame, onset_table: DataFrame, horizon: int, persistence: int = 2,
                        n_shifts: int = 2000, confirm_before_onset: bool = True, min_shift: int | None = None,
                        shift: Column | None = None) -> DataFrame:
    """How many onsets the same alarm series warns about when rotated at random against them.

    An onset's horizon is a few stretches of windows where a run may begin, mostly one. A rotation by r warns about it if
    the next run from a stretch's first window less r begins within the stretch's length. So a rotation of an onset is one
    lookup by (split, window), and rows of a few numbers are all that is shuffled; no series travels with a rotation.
    Windows count from 0 along each split. Without onsets, or a series too short to rotate, the null is empty.
    """
    min_shift = horizon if min_shift is None else min_shift
    shift = hashed_shift() if shift is None else shift
    places = cut_lineage(_run_places(alarms, persistence))
    marks = onset_table.groupBy("split", F.col("onset_w").cast("bigint").alias("onset_w")).agg(F.count("*").alias("weight"))

    low, high = F.greatest(F.col("onset_w") - horizon, F.lit(0)), F.col("onset_w") - (persistence if confirm_before_onset else 1)
    begins = marks.where(low <= high).withColumn("w", F.explode(F.sequence(low, high)))
    begins = begins.join(places.where("allowed").select("split", "w", "n"), ["split", "w"])
    island = F.col("w") - F.row_number().over(Window.partitionBy("split", "onset_w").orderBy("w"))
    stretches = (begins.withColumn("island", island).groupBy("split", "n", "onset_w", "weight", "island")
                 .agg(F.min("w").alias("low"), F.count("*").alias("width")))

    room = F.col("n") > 2 * F.col("min_shift")
    numbers = F.explode(F.when(room, F.sequence(F.lit(-1), F.lit(n_shifts - 1))).otherwise(F.array(F.lit(-1)))).alias("i")  # -1: as it is
    turned = (stretches.withColumn("min_shift", F.lit(min_shift)).select("*", numbers)
              .withColumn("shift", F.when(F.col("i") >= 0, shift).otherwise(F.lit(0)))
              .select("split", "i", "onset_w", "weight", "width", F.pmod(F.col("low") - F.col("shift"), F.col("n")).alias("w")))
    warned = turned.join(places.select("split", "w", "gap"), ["split", "w"]).where(F.col("gap") < F.col("width"))
    counts = (warned.groupBy("split", "i", "onset_w").agg(F.max("weight").alias("weight"))
              .groupBy("split", "i").agg(F.sum("weight").alias("count")))

    sizes = places.groupBy("split").agg(F.max("n").alias("n")).join(marks.groupBy("split").agg(F.count("*").alias("onsets")), "split", "left")
    rotations = sizes.withColumn("min_shift", F.when(F.col("onsets") > 0, F.lit(min_shift))).select("split", numbers)
    count = F.coalesce("count", F.lit(0))
    rolled = rotations.join(counts, ["split", "i"], "left").select(
        "split", F.when(F.col("i") >= 0, count).alias("count"), F.when(F.col("i") < 0, count).alias("as_is"))
    stats = rolled.withColumn("observed", F.max("as_is").over(Window.partitionBy("split"))).groupBy("split").agg(
        F.max("observed").alias("observed"), F.count("count").alias("n_shifts"),
        F.coalesce(F.avg("count"), F.lit(0.0)).alias("null_mean"),
        F.coalesce(F.floor(F.percentile("count", 0.95)), F.lit(0)).alias("null_p95"),
        F.coalesce(F.max("count"), F.lit(0)).alias("null_max"),
        ((F.lit(1) + F.count_if(F.col("count") >= F.col("observed"))) / (F.lit(1) + F.count("count"))).alias("p_value"))
    return stats.withColumn("exceeds_p95", (F.col("n_shifts") > 0) & (F.col("observed") > F.col("null_p95")))


def chi2_tail_even(stat: Column, half_df: Column) -> Column:
    """Survival function of chi-square with an even number of degrees of freedom (a finite sum)."""
    half = stat / 2
    series = F.aggregate(
        F.when(half_df > 1, F.sequence(F.lit(1).cast("long"), (half_df - 1).cast("long"))).otherwise(
            F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct((acc["term"] * half / i).alias("term"), (acc["total"] + acc["term"] * half / i).alias("total")),
        lambda acc: acc["total"])
    return F.exp(-half) * series


def fisher_combine(p_values: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fisher's combination of ``p_value`` per group (clipped to [1e-12, 1], nulls left out)."""
    p = F.greatest(F.least(F.col("p_value"), F.lit(1.0)), F.lit(1e-12))
    stats = p_values.groupBy(*keys).agg(
        (F.lit(-2.0) * F.sum(F.log(p))).alias("chi2"), (F.lit(2) * F.count("p_value")).alias("df"))
    return stats.withColumn("p_combined", F.when(F.col("df") > 0, chi2_tail_even(F.col("chi2"), F.col("df") / 2)))


def reference_windows(states: DataFrame, onset_table: DataFrame, gap: int = REFERENCE_GAP) -> DataFrame:
    """Eligible windows at least ``gap`` from every onset: adds ``reference``."""
    marks = onset_table.select("split", F.col("onset_w").alias("w"), F.lit(1).alias("_o"))
    near = F.max(F.coalesce(F.col("_o"), F.lit(0))).over(along().rowsBetween(-(gap - 1), gap - 1))
    return (states.join(marks, ["split", "w"], "left").withColumn("reference", F.col("eligible") & (near == 0)).drop("_o"))


def lead_bin_percentiles(scored: DataFrame, onset_table: DataFrame, all_onsets: DataFrame,
                         bins: dict[str, tuple[int, int]] = LEAD_BINS) -> DataFrame:
    """Mid-rank percentile of each eligible pre-onset window among its split's reference windows.

    ``scored(split, w, score, eligible)``. One row per (split, onset, offset) that lies in a bin.
    """
    marked = reference_windows(scored, all_onsets)
    ref = F.col("reference").cast("int")
    up_to = Window.partitionBy("split").orderBy("score").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("split", "score")
    placed = marked.withColumns({
        "_le": F.sum(ref).over(up_to), "_eq": F.sum(ref).over(same), "_n": F.sum(ref).over(Window.partitionBy("split"))})
    rank = (F.col("_le") - F.col("_eq") + F.lit(0.5) * F.col("_eq")) / F.col("_n")
    values = placed.where(F.col("eligible") & (F.col("_n") > 0)).select("split", "w", rank.alias("percentile"))
    lows_highs = list(bins.items())
    deepest = max(high for _, (_, high) in lows_highs)
    name = None
    for label, (low, high) in lows_highs:
        test = F.col("offset").between(low, high)
        name = F.when(test, F.lit(label)) if name is None else name.when(test, F.lit(label))
    before = (onset_table.select("split", "onset_w", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("offset"))
              .withColumns({"w": F.col("onset_w") - F.col("offset"), "bin": name}).where(F.col("bin").isNotNull()))
    return before.join(values, ["split", "w"]).select("split", "onset_w", "offset", "bin", "percentile")


def family_breakdown(leads: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Warned and total per onset family."""
    return leads.groupBy(*keys, "family").agg(
        F.count_if("detected_early").alias("warned"), F.count("*").alias("episodes"))
