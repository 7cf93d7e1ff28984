"""Audits and reconciliation of sources, builds and score series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import clean
from tidewatch.functions.labels import effective_stage, map_distinct, map_label
from tidewatch.functions.quantiles import grouped_quantiles
from tidewatch.operators.grid import Grid, _div
from tidewatch.operators.state import stage_from_mask, stage_masks
from tidewatch.schema import IMPACT, STAGES

KEY = ["split", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
#: compared with a tolerance of 2 microseconds rather than exactly
TIME_COLUMNS = {"duration_us", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "active_mean", "idle_mean",
                "fwd_iat_std", "bwd_iat_std"}
EDGE_WINDOWS = 4


# --- R1-R5: audits ----------------------------------------------------------------------------------------

def label_audit(flows: DataFrame) -> DataFrame:
    """Flows and share per (split, label), with the label's stage, technique and attempted flag."""
    counts = flows.groupBy("split", "label").agg(F.count("*").alias("flows"))
    share = F.lit(100.0) * F.col("flows") / F.sum("flows").over(Window.partitionBy("split"))
    mapped = counts.withColumn("share_pct", share).withColumn("m", map_label(F.col("label")))
    return mapped.select("split", "label", "flows", "share_pct", "m.stage", "m.technique", "m.attempted")


def schedule_timing(flows: DataFrame, schedule: DataFrame) -> DataFrame:
    """R2: first and last flow of each attack label against its scheduled time; either side may be missing.

    ``schedule(split, label, start, end)``.
    """
    seen = flows.where(F.col("stage") > 0).groupBy("split", "label").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("flows"))
    return seen.join(schedule, ["split", "label"], "full_outer")


def minute_stages(flows: DataFrame) -> DataFrame:
    """Flows per minute and stage, one column per stage."""
    minute = F.date_trunc("minute", "ts").alias("minute")
    return flows.groupBy("split", minute).agg(*(F.count_if(F.col("stage") == s).alias(n) for s, n in enumerate(STAGES)))


def dominant_and_present(flows: DataFrame, grid: Grid) -> DataFrame:
    """Windows per stage, counted as the window's stage and counted as present at all."""
    masks = grid.fill(stage_masks(flows, grid), ["mask"], keep_ts=False)
    hostile = F.col("mask").bitwiseAND(F.lit((1 << len(STAGES)) - 2))
    held = [F.struct(F.lit(s).alias("stage"), (stage_from_mask(F.col("mask")) == s).cast("int").alias("dominant"),
                     ((hostile == 0) if s == 0 else (hostile.bitwiseAND(F.lit(1 << s)) > 0)).cast("int").alias("present"))
            for s in range(len(STAGES))]
    return (masks.select("split", F.explode(F.array(*held)).alias("h")).groupBy("split", "h.stage")
            .agg(F.sum("h.dominant").alias("dominant"), F.sum("h.present").alias("present")))


def file_profile(flows: DataFrame) -> DataFrame:
    """Rows, time span and label x attempted counts."""
    return flows.groupBy("split", "label", "attempted").agg(
        F.count("*").alias("flows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def attack_endpoints(flows: DataFrame, k: int = 5) -> DataFrame:
    """The exact top-k sources, destinations and ports of every attack label: (split, label, kind, value, flows, rank)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
                                for kind, c in (("src_ip", "src_ip"), ("dst_ip", "dst_ip"), ("dst_port", "dst_port")))))
    # counted per endpoint triple first, so the explode below touches groups, not flows
    triples = flows.where(F.col("stage") > 0).groupBy("split", "label", "src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("c"))
    counts = triples.select("split", "label", "c", kinds.alias("v")).groupBy("split", "label", "v.kind", "v.value").agg(F.sum("c").alias("flows"))
    order = Window.partitionBy("split", "label", "kind").orderBy(F.desc("flows"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- R6-R8: pairing two sources ---------------------------------------------------------------------------

def pair_flows(left: DataFrame, right: DataFrame, tolerance_us: int, left_id: str, right_id: str) -> DataFrame:
    """One-to-one pairs (left id, right id, match): same 5-tuple and time first, then nearest within tolerance.

    Exact pairs are the i-th left and i-th right row of a (5-tuple, time). The nearest search is an equi-join on
    (5-tuple, time bucket as wide as the tolerance) with each right row listed in its bucket and both neighbours.
    """
    a = left.select(*KEY, F.unix_micros("ts").alias("us"), F.col(left_id).alias("a_id"))
    b = right.select(*KEY, F.unix_micros("ts").alias("us"), F.col(right_id).alias("b_id"))
    ia = a.withColumn("_i", F.row_number().over(Window.partitionBy(*KEY, "us").orderBy("a_id")))
    ib = b.withColumn("_i", F.row_number().over(Window.partitionBy(*KEY, "us").orderBy("b_id")))
    exact = ia.join(ib, [*KEY, "us", "_i"]).select("a_id", "b_id", F.lit("exact").alias("match"))

    rest_a = a.join(exact.select("a_id"), "a_id", "left_anti").withColumn("bucket", _div(F.col("us"), tolerance_us))
    rest_b = b.join(exact.select("b_id"), "b_id", "left_anti").withColumnRenamed("us", "b_us")
    home = _div(F.col("b_us"), tolerance_us)
    near_b = rest_b.withColumn("bucket", F.explode(F.sequence(home - 1, home + 1)))
    gap = F.abs(F.col("us") - F.col("b_us"))
    # nearest right row per left row (the earlier one on a tie), then the first left row per right row
    close = rest_a.join(near_b, [*KEY, "bucket"]).withColumn("gap", gap).where(F.col("gap") <= tolerance_us)
    nearest = close.groupBy("a_id", "us").agg(F.min_by("b_id", F.struct("gap", "b_us", "b_id")).alias("b_id"))
    single = nearest.groupBy("b_id").agg(F.min_by("a_id", F.struct("us", "a_id")).alias("a_id"))
    return exact.unionByName(single.select("a_id", "b_id", F.lit("near").alias("match")))


def unmatched(side: DataFrame, pairs: DataFrame, id_column: str, pair_column: str) -> DataFrame:
    return side.join(pairs.select(F.col(pair_column).alias(id_column)), id_column, "left_anti")


def compare_columns(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, columns: list[str]) -> DataFrame:
    """Agreement of each numeric column over paired flows."""
    a = left.select(F.col(left_id).alias("a_id"), *(clean(F.col(c)).alias(f"a_{c}") for c in columns))
    b = right.select(F.col(right_id).alias("b_id"), *(clean(F.col(c)).alias(f"b_{c}") for c in columns))
    joined = pairs.join(a, "a_id").join(b, "b_id")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(2.0 if c in TIME_COLUMNS else 1e-6).alias("tol"),
                                         F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns)))
    rows = joined.select(cells.alias("x")).select("x.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    diff = F.abs(F.col("a") - F.col("b"))
    rows = rows.withColumns({"equal": diff <= F.greatest("tol", F.lit(1e-9) * F.abs("b")),
                             "within": diff <= F.greatest("tol", F.lit(0.01) * F.abs("b"))})
    table = rows.groupBy("column").agg(
        F.count("*").alias("pairs"), F.avg(F.col("equal").cast("int")).alias("equal"), F.avg(F.col("within").cast("int")).alias("within_1pct"),
        F.count_if(~F.col("equal") & (F.col("a") == 0) & (F.col("b") != 0)).alias("left_zero"),
        F.count_if(~F.col("equal") & (F.col("a") != 0) & (F.col("b") == 0)).alias("right_zero"),
        F.avg("a").alias("mean_left"), F.avg("b").alias("mean_right"))
    ratios = rows.where(~F.col("equal") & (F.col("b") != 0)).select("column", (F.col("a") / F.col("b")).alias("r"))
    medians = grouped_quantiles(ratios, ["column"], "r", {"median_ratio": 0.5})
    return table.join(medians, "column", "left")


def explain_unmatched(side: DataFrame, other: DataFrame) -> DataFrame:
    """For each unmatched flow, whether the other source has its 5-tuple at another time, or reversed."""
    tuples = other.select(*KEY).distinct()
    there = tuples.withColumn("same_tuple", F.lit(True))
    swap = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port"}
    back = tuples.select(*(F.col(swap.get(k, k)).alias(k) for k in KEY)).withColumn("reversed_tuple", F.lit(True))
    return (side.join(there, KEY, "left").join(back, KEY, "left").fillna(False, ["same_tuple", "reversed_tuple"])
            .withColumn("pkts", F.col("fwd_pkts") + F.col("bwd_pkts")))


def unmatched_summary(explained: DataFrame) -> DataFrame:
    """Unmatched flows per protocol and packet count (10 and more together), with both flags counted."""
    return explained.groupBy("split", "protocol", F.least("pkts", F.lit(10)).alias("pkts")).agg(
        F.count("*").alias("flows"), F.count_if("reversed_tuple").alias("reversed_tuple"), F.count_if("same_tuple").alias("same_tuple"))


# --- R9-R12: builds and series ----------------------------------------------------------------------------

def matrix_parity(a: DataFrame, b: DataFrame, features: list[str], tolerance: float = 1e-6, edge: int = 0,
                  n_windows: DataFrame | None = None) -> DataFrame:
    """Per feature, cells differing by more than a relative tolerance, worst difference, means and correlation.

    With ``edge`` and ``n_windows(split, n)`` the first and last windows of each split are left out.
    """
    joined = a.select("split", "w", *(F.col(f).alias(f"a_{f}") for f in features)).join(
        b.select("split", "w", *(F.col(f).alias(f"b_{f}") for f in features)), ["split", "w"])
    if edge and n_windows is not None:
        joined = joined.join(n_windows.select("split", "n"), "split").where((F.col("w") >= edge) & (F.col("w") < F.col("n") - edge))
    aggs: list[Column] = [F.count("*").alias("windows")]
    for f in features:
        x, y = F.col(f"a_{f}"), F.col(f"b_{f}")
        rel = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        aggs.append(F.struct(F.count_if(rel > tolerance).alias("mismatches"), F.max(rel).alias("worst"), F.avg(x).alias("mean_a"),
                             F.avg(y).alias("mean_b"), F.corr(x, y).alias("corr")).alias(f"m_{f}"))
    wide = joined.agg(*aggs)
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col("windows"), F.col(f"m_{f}").alias("m")) for f in features))
    return wide.select(F.explode(items).alias("x")).select("x.feature", "x.windows", "x.m.*")


def build_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per split, row counts of two builds and how many rows each holds that the other does not."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        raise ValueError(f"builds have different columns: {sorted(set(a.columns) ^ set(b.columns))}")
    sided = a.select(*cols).withColumn("_side", F.lit(1)).unionByName(b.select(*cols).withColumn("_side", F.lit(-1)))
    # one shuffle instead of two exceptAll: a row in both builds nets to zero
    net = sided.groupBy(*cols).agg(F.sum("_side").alias("net"), F.count_if(F.col("_side") == 1).alias("na"), F.count_if(F.col("_side") == -1).alias("nb"))
    out = net.groupBy("split").agg(F.sum("na").alias("rows_a"), F.sum("nb").alias("rows_b"),
                                   F.sum(F.greatest("net", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def series_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scored, alarmed series joined on (split, ts): windows shared, correlation, alarms of each and of both."""
    joined = a.select("split", "ts", F.col("score").alias("sa"), F.col("alarm").alias("aa")).join(
        b.select("split", "ts", F.col("score").alias("sb"), F.col("alarm").alias("ab")), ["split", "ts"])
    return joined.groupBy("split").agg(
        F.count("*").alias("windows"), F.corr("sa", "sb").alias("corr"), F.count_if("aa").alias("alarms_a"), F.count_if("ab").alias("alarms_b"),
        F.count_if(F.col("aa") & F.col("ab")).alias("alarms_both"))


def correlation_matrix(scores: DataFrame, series: list[str]) -> DataFrame:
    """Pairwise Pearson correlation of named series: from long (split, w, series, score) to (a, b, corr)."""
    wide = scores.groupBy("split", "w").pivot("series", series).agg(F.first("score"))
    pairs = [(x, y) for i, x in enumerate(series) for y in series[i:]]
    row = wide.agg(*(F.corr(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)))
    items = F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr")) for i, (x, y) in enumerate(pairs)))
    return row.select(F.explode(items).alias("x")).select("x.*")


def prefix_difference(whole: DataFrame, prefix: DataFrame, columns: list[str]) -> DataFrame:
    """Largest difference of each column between a causal result on a prefix and the same windows of the whole."""
    joined = whole.select("split", "w", *(F.col(c).alias(f"a_{c}") for c in columns)).join(
        prefix.select("split", "w", *(F.col(c).alias(f"b_{c}") for c in columns)), ["split", "w"])
    return joined.groupBy("split").agg(F.count("*").alias("windows"), *(
        F.coalesce(F.max(F.abs(F.coalesce(F.col(f"a_{c}").cast("double"), F.lit(-1.0)) - F.coalesce(F.col(f"b_{c}").cast("double"), F.lit(-1.0)))), F.lit(0.0)).alias(c)
        for c in columns))


def clip_rates(states: DataFrame, columns: list[str], bound: float = 10.0) -> DataFrame:
    """Share of windows where a clipped column sits on its bound: overall, on attack and on benign windows."""
    attack = F.col("attack_now") > 0
    aggs = []
    for c in columns:
        hit = (F.abs(F.col(c)) >= bound).cast("int")
        aggs.append(F.struct(F.avg(hit).alias("overall"), F.avg(F.when(attack, hit)).alias("attack"), F.avg(F.when(~attack, hit)).alias("benign")).alias(c))
    wide = states.groupBy("split").agg(*aggs)
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("m")) for c in columns))
    return wide.select("split", F.explode(items).alias("x")).select("split", "x.column", "x.m.*")
