"""Structured Streaming forms of the causal operators (X1, X2, X4, X8, X11): declarative aggregations.

Event time is ``ts`` (TIMESTAMP, UTC). The batch grid is anchored at each split's first minute; a stream has no
first minute yet, so windows here lie on a fixed anchor, and windows before it are filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import flow_shape, zero_if_null
from tidewatch.functions.labels import effective_stage
from tidewatch.operators.flows import flow_packets, payload_buckets
from tidewatch.operators.grid import WindowSpec
from tidewatch.operators.state import stage_from_mask
from tidewatch.schema import RATE_BASES, STAGES


def _window(spec: WindowSpec, anchor: str = "0 seconds") -> Column:
    return F.window("ts", f"{spec.length_us} microseconds", f"{spec.stride_us} microseconds", anchor)


def live_windows(flows: DataFrame, spec: WindowSpec, internal: tuple[str, ...], delay: str = "60 seconds", since: Column | None = None,
                 anchor: str = "0 seconds") -> DataFrame:
    """Overlapping-window volume, rates, spread and stage on a live feed, in append mode.

    Exact distinct counts are not possible in one streaming aggregate; ``live_distinct`` gives them in two.
    """
    shape = flow_shape(internal)
    bit = F.lit(1)
    for s in range(1, len(STAGES)):
        bit = F.when(effective_stage() == s, F.lit(1 << s)).otherwise(bit)
    length = F.lit(spec.length_s)
    n = F.count("*")
    out = flows.withWatermark("ts", delay).groupBy("split", _window(spec, anchor).alias("win")).agg(
        n.alias("n_flows"), (n / length).alias("flows_per_s"), F.sum(shape["bytes"]).alias("bytes_total"), F.sum(shape["pkts"]).alias("pkts_total"),
        *(F.avg(shape[c].cast("double")).alias(f"{c}_rate") for c in RATE_BASES),
        F.approx_count_distinct("src_ip").alias("uniq_src_ip"), F.approx_count_distinct("dst_ip").alias("uniq_dst_ip"),
        F.approx_count_distinct("dst_port").alias("uniq_dst_port"), F.bit_or(bit).alias("mask"))
    out = out.select("split", F.col("win.start").alias("ts"), *(c for c in out.columns if c not in ("split", "win", "mask")),
                     stage_from_mask(F.col("mask")).alias("stage"))
    return out if since is None else out.where(F.col("ts") >= since)


def live_distinct(flows: DataFrame, spec: WindowSpec, key: str, delay: str = "60 seconds", since: Column | None = None,
                  anchor: str = "0 seconds") -> DataFrame:
    """Exact distinct ``key`` and flow counts per window: two chained stateful aggregations in append mode."""
    per_key = flows.withWatermark("ts", delay).groupBy("split", _window(spec, anchor).alias("win"), key).agg(F.count("*").alias("c"))
    out = per_key.groupBy("split", "win").agg(F.count("*").alias(f"uniq_{key}"), F.sum("c").alias("n_flows"))
    out = out.select("split", F.col("win.start").alias("ts"), f"uniq_{key}", "n_flows")
    return out if since is None else out.where(F.col("ts") >= since)


def live_minute_stages(flows: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Tumbling counts per minute and stage."""
    out = flows.withWatermark("ts", delay).groupBy("split", F.window("ts", "1 minute").alias("win")).agg(
        *(F.count_if(F.col("stage") == s).alias(name) for s, name in enumerate(STAGES)))
    return out.select("split", F.col("win.start").alias("minute"), *STAGES)


def live_session_stats(packets: DataFrame, gap: str = "120 seconds", delay: str = "60 seconds") -> DataFrame:
    """The statistics of F4 per directed 5-tuple and session (``gap`` without a packet ends one).

    As there, only TCP and UDP packets with ports count and window statistics are TCP's. Repeated sequence numbers are
    left out: they depend on the order of neighbours, which an aggregate over a stream does not have.
    """
    keys = ["split", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    window = F.when(F.col("protocol") == 6, F.col("tcp_win"))
    out = flow_packets(packets).withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("ses")).agg(
        F.count("*").alias("packet_count"), F.avg("ttl").alias("ttl_mean"), F.var_pop("ttl").alias("ttl_variance"),
        zero_if_null(F.avg(window)).alias("tcp_win_mean"), zero_if_null(F.max(window).cast("double")).alias("tcp_win_max"),
        F.count_if(F.col("more_frags") | (F.col("frag_off") > 0)).alias("ip_frag_count"),
        *(F.count_if(test).alias(name) for name, test in payload_buckets().items()))
    return out.select(*keys, F.col("ses.start").alias("first_ts"), *(c for c in out.columns if c not in (*keys, "ses")))


def live_alarm_runs(alarms: DataFrame, spec: WindowSpec, delay: str = "60 seconds") -> DataFrame:
    """X11: contiguous alarmed windows; a run closes at the first window that is not alarmed.

    Alarmed windows one stride apart share a session whose gap is just over a stride.
    """
    hot = alarms.where("alarm").withWatermark("ts", delay)
    gap = f"{spec.stride_us + 1} microseconds"
    out = hot.groupBy("split", F.session_window("ts", gap).alias("ses")).agg(
        F.count("*").alias("windows"), F.max("score").alias("peak"), F.min("w").alias("begin_w"), F.max("w").alias("end_w"))
    return out.select("split", "begin_w", "end_w", "windows", "peak")


def late_rows(query) -> int:
    """Rows a running query dropped as too late, over the progress reports it still holds."""
    total = 0
    for report in query.recentProgress:
        for op in report.get("stateOperators", []):
            total += op.get("numRowsDroppedByWatermark", 0)
    return total
