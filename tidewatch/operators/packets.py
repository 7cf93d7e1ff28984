"""Packet windows: duplicates, retransmissions, the per-window packet block and its merge."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import bin_of, zero_if_null
from tidewatch.operators.flows import ACK, ORDER, RST, SYN, has_flag
from tidewatch.operators.grid import Grid, _div
from tidewatch.operators.state import BEACON_PIECES
from tidewatch.operators.stretches import speculate
from tidewatch.schema import HAS_PCAP, PAYLOAD_BINS, PCAP_FEATURES

DUPLICATE_FRAMES = 64


def drop_capture_duplicates(packets: DataFrame, frames: int = DUPLICATE_FRAMES) -> DataFrame:
    """Drop a packet whose bytes equal those of one of the last ``frames`` packets kept of its capture.

    What is kept depends on what was kept before, but only on the last ``frames`` digests: stretches of a capture are walked at
    once, from no digests at first, and again only where the digests the stretch before ends with make a difference.
    Skipped frames carry no digest; they stay and do not count.
    """
    def step(recent: deque, digest) -> tuple[deque, int]:
        if digest is None:
            return recent, 0
        if digest in recent:
            return recent, 1
        recent.append(digest)
        return recent, 0

    folded = speculate(packets, ["split", "capture"], ["frame_no", "ts"], ["ip_digest"], lambda: deque(maxlen=frames), step, "_again")
    return folded.where(F.col("_again") == 0).drop("_again")


def capture_manifest(packets: DataFrame, kept: DataFrame) -> DataFrame:
    """Per capture, packets, frames skipped, duplicates dropped, first and last packet time."""
    seen = packets.groupBy("split", "capture").agg(
        F.count_if(~F.coalesce("skipped", F.lit(False))).alias("read"), F.count_if(F.coalesce("skipped", F.lit(False))).alias("frames_skipped"))
    left = kept.where(~F.coalesce("skipped", F.lit(False))).groupBy("split", "capture").agg(
        F.count("*").alias("packets"), F.min("ts").alias("first_packet"), F.max("ts").alias("last_packet"))
    return seen.join(left, ["split", "capture"], "left").select(
        "split", "capture", F.coalesce("packets", F.lit(0)).alias("packets"), "frames_skipped",
        (F.col("read") - F.coalesce("packets", F.lit(0))).alias("duplicates_dropped"), "first_packet", "last_packet")


def _seq_step(furthest, seq: int, payload: int):
    end = (seq + payload) & 0xFFFFFFFF
    if furthest is not None and ((furthest - end) & 0xFFFFFFFF) < 0x80000000:
        return furthest, 1
    return end, 0


def with_retransmissions(packets: DataFrame) -> DataFrame:
    """adds ``retrans`` (0/1): a TCP data segment that ends at or before the furthest end already seen in
    its direction, modulo 2^32.

    Stretches of a direction are walked at once. The furthest end a stretch reaches is its own wherever the sequence
    numbers have moved on, whatever came before, so two walks settle it; only TCP data segments are shuffled.
    """
    rest = packets.where(~_data()).withColumn("retrans", F.lit(0).cast("long"))
    return _marked(packets.where(_data())).unionByName(rest)


def _data() -> Column:
    return (F.col("protocol") == 6) & (F.col("payload_len") > 0) & (F.col("frag_off") == 0)


def _marked(segments: DataFrame, kept: list[str] | None = None) -> DataFrame:
    keys = ["split", "src_ip", "dst_ip", "src_port", "dst_port"]
    return speculate(segments, keys, ORDER, ["seq", "payload_len"], lambda: None, _seq_step, "retrans", kept=kept)


def retransmissions_by_slice(packets: DataFrame, grid: Grid) -> DataFrame:
    """F6, counted: retransmitted segments per slice of time. Of a segment only what the rule and the grid read is shuffled."""
    segments = packets.where(_data()).select("split", "src_ip", "dst_ip", "src_port", "dst_port", *ORDER, "seq", "payload_len", "ts")
    again = _marked(segments, ["split", "ts"]).where(F.col("retrans") > 0)
    return grid.locate(again).groupBy("split", "slice_no", "n").agg(F.sum("retrans").alias("retrans"))


def packet_window_features(packets: DataFrame, grid: Grid, retransmitted: DataFrame | None = None) -> DataFrame:
    """18 packet statistics per window. Retransmissions are those ``retransmitted`` counts by slice, or else those ``packets`` mark
    in ``retrans``; with neither, none count.

    The gap before a packet comes from a sort inside short pieces of time; the one gap that crosses from piece
    to piece is added from the pieces' summary. TTL statistics come from a (slice, TTL) histogram.
    """
    if "retrans" not in packets.columns:
        packets = packets.withColumn("retrans", F.lit(0).cast("long"))
    spec = grid.spec
    pieces = BEACON_PIECES if spec.slice_us % BEACON_PIECES == 0 else 1
    located = grid.locate(packets)
    tcp = F.col("protocol") == 6
    win = tcp & F.col("tcp_win").isNotNull() & ~has_flag(RST)
    pay = F.col("payload_len")
    part = bin_of(pay)
    frag = F.col("more_frags") | (F.col("frag_off") > 0)
    at = F.col("off_us") / F.lit(1e6)
    rows = located.withColumns({"piece": _div(F.col("off_us"), spec.slice_us // pieces), "at": at})
    inside = Window.partitionBy("split", "piece").orderBy("at")
    rows = rows.withColumn("gap", F.col("at") - F.lag("at").over(inside))
    w = F.when(win, F.col("tcp_win").cast("double"))
    per_piece = rows.groupBy("split", "piece", "n").agg(
        F.count("*").alias("pkts"), F.count_if(tcp).alias("tcp"), F.count_if(frag).alias("frag"), F.sum("retrans").alias("retrans"),
        F.count_if(tcp & (pay > 0)).alias("data"), F.count_if(win & (F.col("tcp_win") == 0)).alias("zero"),
        F.count(w).alias("wk"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"),
        *(F.count_if(part == b).alias(f"bin{b}") for b in range(5)),
        F.count("gap").alias("gk"), zero_if_null(F.sum("gap")).alias("g1"), zero_if_null(F.sum(F.col("gap") * F.col("gap"))).alias("g2"),
        F.min("at").alias("first"), F.max("at").alias("last"),
        F.count_if(tcp & has_flag(SYN) & ~has_flag(ACK)).alias("syn"), F.count_if(tcp & has_flag(RST)).alias("rst"))
    crossing = F.col("first") - F.lag("last").over(Window.partitionBy("split").orderBy("piece"))
    joined = per_piece.withColumn("x", crossing).withColumns({
        "gk": F.col("gk") + F.col("x").isNotNull().cast("int"), "g1": F.col("g1") + zero_if_null(F.col("x")),
        "g2": F.col("g2") + zero_if_null(F.col("x") * F.col("x")), "slice_no": _div(F.col("piece"), pieces)})

    if retransmitted is not None:
        joined = joined.drop("retrans").unionByName(retransmitted, allowMissingColumns=True)

    def s(c: str) -> Column:
        return F.sum(c)

    def rate(top: str, bottom: str) -> Column:
        return F.try_divide(s(top), s(bottom))

    def spread(total: Column, squares: Column, k: Column) -> Column:
        return F.sqrt(F.greatest(squares / k - (total / k) * (total / k), F.lit(0.0)))

    gaps = s("gk")
    gap_std = F.when(gaps > 1, spread(s("g1"), s("g2"), gaps))
    gap_mean = F.when((gaps > 1) & (s("g1") > 0), s("g1") / gaps)
    main = grid.to_windows(joined).groupBy("split", "w").agg(
        s("pkts").alias("pcap_pkts"), rate("frag", "pkts").alias("pcap_frag_rate"), rate("retrans", "data").alias("pcap_retrans_rate"),
        rate("zero", "tcp").alias("pcap_zero_win_rate"), F.when(s("wk") > 0, spread(s("w1"), s("w2"), s("wk"))).alias("pcap_win_std"),
        *(rate(f"bin{b}", "pkts").alias(f"pcap_{name}") for b, name in enumerate(PAYLOAD_BINS)),
        gap_std.alias("pcap_iat_std"), (gap_std / gap_mean).alias("pcap_iat_cv"),
        rate("syn", "tcp").alias("pcap_syn_only_rate"), rate("rst", "tcp").alias("pcap_rst_rate"))

    hist = grid.to_windows(located.groupBy("split", "slice_no", "n", "ttl").agg(F.count("*").alias("c")))
    t, c = F.col("ttl").cast("double"), F.col("c")
    k = F.sum(c)
    ttl = hist.groupBy("split", "w").agg(
        (F.sum(t * c) / k).alias("pcap_ttl_mean"), spread(F.sum(t * c), F.sum(t * t * c), k).alias("pcap_ttl_std"),
        F.count_distinct("ttl").alias("pcap_ttl_distinct"), (F.sum(F.when(t < 60, c).otherwise(0)) / k).alias("pcap_ttl_low_rate"))
    block = main.join(ttl, ["split", "w"], "left")
    return grid.fill(block, list(PCAP_FEATURES), keep_ts=False).select(
        "split", "w", *(F.col(c).cast("double").alias(c) for c in PCAP_FEATURES))


def with_packets(states: DataFrame, packet_windows: DataFrame | None) -> DataFrame:
    """Attach measured packet columns (``has_pcap`` = 1), or their absent form (all 0)."""
    if packet_windows is None:
        return states.withColumns({c: F.lit(0.0) for c in (*PCAP_FEATURES, HAS_PCAP)})
    joined = states.join(packet_windows.select("split", "w", *PCAP_FEATURES), ["split", "w"], "left")
    return joined.fillna(0.0, list(PCAP_FEATURES)).withColumn(HAS_PCAP, F.lit(1.0))


def mask_packets(states: DataFrame) -> DataFrame:
    """The same windows with packets absent."""
    present = [c for c in (*PCAP_FEATURES, HAS_PCAP) if c in states.columns]
    return states.withColumns({c: F.lit(0.0) for c in present})


def packet_flow_alignment(states: DataFrame) -> DataFrame:
    """Per split, correlation of log packet counts on busy windows and the ratio of totals."""
    busy = F.col("pkts_total") > 0
    a, b = F.when(busy, F.log1p("pcap_pkts")), F.when(busy, F.log1p("pkts_total"))
    return states.groupBy("split").agg(
        F.corr(a, b).alias("corr_log_packets"), (F.sum("pcap_pkts") / F.greatest(F.sum("pkts_total"), F.lit(1.0))).alias("packet_ratio"),
        F.avg("pcap_retrans_rate").alias("retrans_rate_mean"), F.max("pcap_frag_rate").alias("frag_rate_max"))
