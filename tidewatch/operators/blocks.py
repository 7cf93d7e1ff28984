"""Optional feature blocks and host views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import (bin_of, clean, entropy_bits, flow_shape, zero_if_null)
from tidewatch.functions.labels import has_prefix
from tidewatch.functions.quantiles import grouped_quantiles
from tidewatch.operators.grid import Grid
from tidewatch.operators.series import along, before, clipped, slope
from tidewatch.schema import (BASELINE_MIN, BASELINE_WINDOWS, FLOW_PACKET_FEATURES, HOST_RELATIVE_FEATURES,
                              HOST_SLOT_FEATURES, PACKET_STAT_COLUMNS, PAYLOAD_BINS, TREND_BASES, TREND_SLOPES,
                              Z_CLIP, host_slot_names)


# --- B1 ---------------------------------------------------------------------------------------------------

def trend_features(states: DataFrame, bases=TREND_BASES, baseline: int = BASELINE_WINDOWS,
                   min_periods: int = BASELINE_MIN) -> DataFrame:
    """B1: delta, two slopes and a trailing z-score per base column; all from windows at or before w."""
    added: dict[str, Column] = {}
    past = before(baseline)
    for base in bases:
        x = F.col(base)
        added[f"{base}_delta"] = F.coalesce(x - F.lag(x).over(along()), F.lit(0.0))
        for span in TREND_SLOPES:
            added[f"{base}_slope_{span}"] = slope(x, span)
        spread = F.greatest(F.stddev_samp(x).over(past), F.lit(1e-6))
        z = (x - F.avg(x).over(past)) / spread
        added[f"{base}_zscore"] = F.when(F.count(x).over(past) >= min_periods,
                                         clipped(z, Z_CLIP)).otherwise(F.lit(0.0))
    return states.withColumns(added)


# --- per-host tables shared by B2, B4, B9 -----------------------------------------------------------------

def _inside(flows: DataFrame, internal: tuple[str, ...]) -> DataFrame:
    return flows.where(has_prefix(F.col("src_ip"), internal))


def host_windows(flows: DataFrame, grid: Grid, internal: tuple[str, ...]) -> DataFrame:
    """(split, w, src_ip, flows, fanout, ports, sent, received) for internal sources."""
    located = grid.locate(_inside(flows, internal)
                          .select("split", "ts", "src_ip", "dst_ip", "dst_port", "fwd_bytes", "bwd_bytes"))
    sliced = located.groupBy("split", "slice_no", "n", "src_ip", "dst_ip", "dst_port").agg(
        F.count("*").alias("c"), F.sum("fwd_bytes").alias("sent"), F.sum("bwd_bytes").alias("received"))
    port = F.col("dst_port").cast("string")
    facets = F.explode(F.array(F.struct(F.lit(0).alias("facet"), F.col("dst_ip").alias("key")),
                               F.struct(F.lit(1).alias("facet"), port.alias("key"))))
    keyed = (grid.to_windows(sliced).select("split", "w", "src_ip", "c", "sent", "received", facets.alias("f"))
             .select("split", "w", "src_ip", "c", "sent", "received", "f.*")
             .groupBy("split", "w", "src_ip", "facet", "key")
             .agg(F.sum("c").alias("c"), F.sum("sent").alias("sent"), F.sum("received").alias("received")))
    peer = F.col("facet") == 0
    return keyed.groupBy("split", "w", "src_ip").agg(
        F.sum(F.when(peer, F.col("c"))).alias("flows"), F.count_if(peer).alias("fanout"),
        F.count_if(~peer).alias("ports"), F.sum(F.when(peer, F.col("sent"))).alias("sent"),
        F.sum(F.when(peer, F.col("received"))).alias("received"))


def first_contacts(flows: DataFrame, grid: Grid, internal: tuple[str, ...], key: str) -> DataFrame:
    """(split, src_ip, w, fresh): how many values of ``key`` a host uses for the first time in window w.

    The first window of a (host, key) is the first window holding its earliest slice, so one min() does it.
    """
    first = (grid.locate(_inside(flows, internal).select("split", "ts", "src_ip", key))
             .groupBy("split", "n", "src_ip", key).agg(F.min("slice_no").alias("slice_no")))
    return (first.select("split", "src_ip", grid.spec.first_window(F.col("slice_no")).alias("w"))
            .groupBy("split", "src_ip", "w").agg(F.count("*").alias("fresh")))


# --- B2 ---------------------------------------------------------------------------------------------------

def host_slots(flows: DataFrame, grid: Grid, internal: tuple[str, ...], slots: int) -> DataFrame:
    """B2: one group of columns per busiest internal source of the window (flows desc, address asc)."""
    order = Window.partitionBy("split", "w").orderBy(F.desc("flows"), "src_ip")
    hosts = (host_windows(flows, grid, internal)
             .withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= slots)
             .join(first_contacts(flows, grid, internal, "dst_ip"), ["split", "w", "src_ip"], "left"))
    value = {
        "fanout": F.col("fanout").cast("double"), "ports": F.col("ports").cast("double"),
        "byte_asym": (F.col("sent") - F.col("received")) / (F.col("sent") + F.col("received") + F.lit(1.0)),
        "new_peer_rate": F.coalesce(F.col("fresh"), F.lit(0)) / F.col("fanout"),
    }
    wide = hosts.groupBy("split", "w").agg(*(
        F.max(F.when(F.col("slot") == i, value[name])).alias(f"host{i}_{name}")
        for i in range(1, slots + 1) for name in HOST_SLOT_FEATURES))
    return grid.fill(wide, list(host_slot_names(slots)), keep_ts=False)


# --- B3 ---------------------------------------------------------------------------------------------------

def flow_packet_features(flows: DataFrame, grid: Grid, internal: tuple[str, ...] = ()) -> DataFrame:
    """The 17 packet statistics a flow meter records; an absent optional column counts as 0."""
    have = set(flows.columns)
    flows = flows.withColumns({c: F.lit(0.0) for c in PACKET_STAT_COLUMNS if c not in have})
    tcp = F.col("protocol") == 6
    pkts = F.col("fwd_pkts") + F.col("bwd_pkts")
    part = bin_of(clean(F.col("pkt_len_mean")))
    stat = {c: F.coalesce(clean(F.col(c)), F.lit(0.0)) for c in PACKET_STAT_COLUMNS}
    hdr = F.when(tcp & (F.col("fwd_pkts") > 0), stat["fwd_hdr_bytes"] / F.col("fwd_pkts"))
    located = grid.locate(flows)
    sliced = located.groupBy("split", "slice_no", "n").agg(
        F.count("*").alias("c"), F.count_if(tcp).alias("tcp"),
        F.count_if(tcp & (F.col("fwd_init_win") == 0)).alias("zero"),
        F.count_if(tcp & (F.col("fwd_init_win") > 0) & (F.col("fwd_init_win") < 1024)).alias("small"),
        F.sum(pkts).alias("pkts"),
        *(F.sum(F.when(part == b, pkts).otherwise(0)).alias(f"bin{b}") for b in range(5)),
        *(F.sum(stat[c]).alias(c) for c in ("fwd_pkt_len_std", "bwd_pkt_len_std", "fwd_iat_std", "bwd_iat_std")),
        F.count_if(stat["bwd_rst_cnt"] > 0).alias("rst"),
        F.count_if(tcp & (F.col("syn_cnt") > 0) & (F.col("fwd_pkts") <= 2)
                   & (stat["fwd_data_pkts"] == 0)).alias("probe"),
        F.sum(hdr).alias("hdr"), F.count(hdr).alias("hdr_k"))
    n = F.sum("c")
    totals = grid.to_windows(sliced).groupBy("split", "w").agg(
        F.try_divide(F.sum("zero"), F.sum("tcp")).alias("pkt_win_zero_rate"),
        F.try_divide(F.sum("small"), F.sum("tcp")).alias("pkt_win_small_rate"),
        *(F.try_divide(F.sum(f"bin{b}"), F.sum("pkts")).alias(f"pkt_{name}") for b, name in enumerate(PAYLOAD_BINS)),
        (F.sum("fwd_pkt_len_std") / n).alias("pkt_fwd_len_std_mean"),
        (F.sum("bwd_pkt_len_std") / n).alias("pkt_bwd_len_std_mean"),
        (F.sum("fwd_iat_std") / n).alias("pkt_fwd_iat_std_mean"),
        (F.sum("bwd_iat_std") / n).alias("pkt_bwd_iat_std_mean"),
        (F.sum("rst") / n).alias("pkt_bwd_rst_rate"), (F.sum("probe") / n).alias("pkt_syn_probe_rate"),
        F.try_divide(F.sum("hdr"), F.sum("hdr_k")).alias("pkt_fwd_hdr_per_pkt_mean"))

    opening = (grid.to_windows(
        grid.locate(flows.where(tcp & F.col("fwd_init_win").isNotNull()).select("split", "ts", "fwd_init_win"))
        .groupBy("split", "slice_no", "n", "fwd_init_win").agg(F.count("*").alias("c")))
        .groupBy("split", "w", "fwd_init_win").agg(F.sum("c").alias("c"))
        .groupBy("split", "w").agg(
            F.count("*").alias("pkt_win_distinct"),
            entropy_bits(F.sum("c"), F.sum(F.col("c") * F.log2("c"))).alias("pkt_win_entropy")))

    iat_mean = clean(F.col("flow_iat_mean"))
    cv = clean(F.col("flow_iat_std")) / iat_mean
    regular = grid.to_windows(
        grid.locate(flows.where((pkts >= 3) & (iat_mean > 0)).select("split", "ts", cv.alias("cv")))
        .where(F.col("cv").isNotNull())
        .groupBy("split", "slice_no", "n", "cv").agg(F.count("*").alias("c")))
    median = grouped_quantiles(regular, ["split", "w"], "cv", {"pkt_iat_cv_median": 0.5}, weight="c")

    block = totals.join(opening, ["split", "w"], "left").join(median, ["split", "w"], "left")
    return grid.fill(block, list(FLOW_PACKET_FEATURES), keep_ts=False).select(
        "split", "w", *(F.col(c).cast("double").alias(c) for c in FLOW_PACKET_FEATURES))


# --- B4 ---------------------------------------------------------------------------------------------------

def host_relative_features(flows: DataFrame, grid: Grid, internal: tuple[str, ...],
                           baseline: int = BASELINE_WINDOWS, min_periods: int = BASELINE_MIN) -> DataFrame:
    """Each internal host against its own trailing past.

    The definition is over a dense host x window table in which a silent host counts 0. Only active rows are
    kept: a host silent at w scores at most 0, and exactly 0 when it was also silent for the whole baseline.
    So windows with at least one such host take max(active z, 0); only windows where *every* host was active
    within the baseline need their silent rows, and just those are generated. The result is the dense one.
    """
    hosts = host_windows(flows, grid, internal).select("split", "w", "src_ip", "flows", "fanout", "ports")
    host = Window.partitionBy("split", "src_ip")
    spans = hosts.withColumn("next_w", F.lead("w").over(host.orderBy("w")))
    spans = spans.join(grid.spans.select("split", "n"), "split")
    until = F.least(F.col("w") + baseline, F.coalesce(F.col("next_w") - 1, F.col("n") - 1), F.col("n") - 1)
    spans = spans.withColumn("until_w", until)
    total = hosts.select("split", "src_ip").distinct().groupBy("split").agg(F.count("*").alias("hosts"))

    # hosts "recent" at w (active within the baseline, w included), by +1 / -1 events along the spine
    events = spans.select("split", F.explode(F.array(
        F.struct(F.col("w").alias("w"), F.lit(1).alias("d")),
        F.struct((F.col("until_w") + 1).alias("w"), F.lit(-1).alias("d")))).alias("e")).select("split", "e.*")
    change = events.groupBy("split", "w").agg(F.sum("d").alias("d"))
    recent = F.sum(F.coalesce(F.col("d"), F.lit(0))).over(along())
    crowded = (grid.spine().drop("ts").join(change, ["split", "w"], "left").withColumn("recent", recent)
               .join(total, "split").withColumn("crowded", F.col("recent") == F.col("hosts")))

    silent = (spans.where(F.col("until_w") > F.col("w"))
              .select("split", "src_ip", F.explode(F.sequence(F.col("w") + 1, F.col("until_w"))).alias("w"))
              .join(crowded.where("crowded").select("split", "w"), ["split", "w"], "left_semi")
              .withColumns({c: F.lit(0).cast("long") for c in ("flows", "fanout", "ports")}))
    rows = hosts.unionByName(silent)

    past = host.orderBy("w").rangeBetween(-baseline, -1)
    k = F.least(F.col("w"), F.lit(baseline).cast("long")).cast("double")
    warm = F.col("w") >= min_periods

    def mean(col: str) -> Column:
        return zero_if_null(F.sum(col).over(past)) / k

    def z(col: str) -> Column:
        total_, squares = zero_if_null(F.sum(col).over(past)), zero_if_null(F.sum(F.col(col) * F.col(col)).over(past))
        std = F.sqrt(F.greatest((squares - total_ * total_ / k) / (k - 1), F.lit(0.0)))
        return F.when(warm, clipped((F.col(col) - total_ / k) / F.greatest(std, F.lit(1.0)), Z_CLIP))

    scored = rows.select("split", "w", z("ports").alias("pz"), z("fanout").alias("fz"),
                         F.when(warm, F.col("flows") / (F.lit(1.0) + mean("flows"))).alias("ratio"))
    best = scored.groupBy("split", "w").agg(F.max("pz").alias("pz"), F.max("fz").alias("fz"), F.max("ratio").alias("ratio"))

    peers = _fresh_after_first(flows, grid, internal, "dst_ip").groupBy("split", "w").agg(
        F.count("*").alias("hostrel_new_peer_hosts"))
    ports = _fresh_after_first(flows, grid, internal, "dst_port").groupBy("split", "w").agg(
        F.max("fresh").alias("hostrel_new_ports_max"))
    newcomers = hosts.groupBy("split", "src_ip").agg(F.min("w").alias("w")).groupBy("split", "w").agg(
        F.count("*").alias("hostrel_new_hosts"))

    def floor(col: str) -> Column:
        return F.when(F.col("w") < min_periods, F.lit(0.0)).when(
            F.col("crowded"), zero_if_null(F.col(col))).otherwise(F.greatest(zero_if_null(F.col(col)), F.lit(0.0)))

    out = crowded.select("split", "w", "crowded")
    for part in (best, peers, ports, newcomers):
        out = out.join(part, ["split", "w"], "left")
    out = out.withColumns({"hostrel_ports_z_max": floor("pz"), "hostrel_fanout_z_max": floor("fz"),
                           "hostrel_flows_ratio_max": zero_if_null(F.col("ratio"))})
    return grid.fill(out.drop("crowded"), list(HOST_RELATIVE_FEATURES), keep_ts=False).select(
        "split", "w", *(F.col(c).cast("double").alias(c) for c in HOST_RELATIVE_FEATURES))


def _fresh_after_first(flows: DataFrame, grid: Grid, internal: tuple[str, ...], key: str) -> DataFrame:
    """First uses of ``key``, leaving out the host's own first window (it has no past to be new against)."""
    fresh = first_contacts(flows, grid, internal, key)
    start = F.min("w").over(Window.partitionBy("split", "src_ip"))
    return fresh.withColumn("start", start).where(F.col("w") > F.col("start"))


# --- B8-B10 -----------------------------------------------------------------------------------------------

def _benign_spread(flows: DataFrame, grid: Grid, column: str) -> DataFrame:
    """(split, w, side, host, c): distinct ``column`` of benign flows per window, hosts as sources and as destinations."""
    benign = flows.where(F.col("stage") == 0)
    sides = []
    for side in ("src_ip", "dst_ip"):
        key = [side] if side == column else [side, column]
        seen = grid.locate(benign.select("split", "ts", *key)).select("split", "slice_no", "n", *key).distinct()
        counts = (grid.to_windows(seen).select("split", "w", *key).distinct()
                  .groupBy("split", "w", F.col(side).alias("host")).agg(F.count("*").alias("c")))
        sides.append(counts.withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def _segments(offset: Column, horizon: int, baseline: int, after: int) -> list[Column]:
    """Mean of ``c`` per window in each segment around an onset ``offset`` windows away."""
    lengths = {"baseline": (-horizon - baseline, -horizon), "run_up": (-horizon, 0), "after": (2, after)}
    return [(zero_if_null(F.sum(F.when((offset >= lo) & (offset < hi), F.col("c")))) / F.lit(float(max(1, hi - lo)))).alias(name)
            for name, (lo, hi) in lengths.items()]


def segment_contributions(flows: DataFrame, grid: Grid, onset: int, horizon: int, baseline: int, after: int,
                          column: str = "dst_port") -> DataFrame:
    """Per host, mean distinct ``column`` per window before, in the run-up to and after an onset.

    Only benign flows; hosts as sources and as destinations; ordered by the run-up's increase.
    """
    offset = F.col("w") - F.lit(onset)
    near = _benign_spread(flows, grid, column).where((offset >= -horizon - baseline) & (offset < after))
    table = near.groupBy("split", "side", "host").agg(*_segments(offset, horizon, baseline, after))
    return table.withColumn("delta", F.col("run_up") - F.col("baseline"))


def onset_contributions(flows: DataFrame, grid: Grid, onset_table: DataFrame, horizon: int, baseline: int, after: int,
                        column: str = "dst_port") -> DataFrame:
    """B8 for every onset of a table (split, onset_w): ``segment_contributions`` around each, one row per onset, side and host.

    Each onset is spread over the windows of its segments, so counts meet it in an equi-join on (split, w); a host's
    counts are repeated only for onsets whose segments overlap.
    """
    around = F.sequence(F.col("onset_w") - (horizon + baseline), F.col("onset_w") + (after - 1))
    marks = onset_table.select("split", F.col("onset_w").cast("bigint").alias("onset_w")).distinct().withColumn("w", F.explode(around))
    near = _benign_spread(flows, grid, column).join(marks, ["split", "w"])
    table = near.groupBy("split", "onset_w", "side", "host").agg(*_segments(F.col("w") - F.col("onset_w"), horizon, baseline, after))
    return table.withColumn("delta", F.col("run_up") - F.col("baseline"))


def host_views(flows: DataFrame, grid: Grid, internal: tuple[str, ...], bad_hosts: DataFrame) -> DataFrame:
    """Per window five statistics, network-wide, max over internal hosts, and for listed hosts only.

    ``bad_hosts(split, src_ip)`` is joined by equality on the pre-aggregated host rows, never broadcast blindly.
    """
    shape = flow_shape(internal)
    wide = flows.withColumns({
        "bytes": shape["bytes"], "inside": shape["src_internal"],
        "unanswered": (shape["proto_tcp"] & (F.col("syn_cnt") > 0) & (F.col("bwd_pkts") == 0)).cast("long")})
    sliced = (grid.locate(wide).groupBy("split", "slice_no", "n", "src_ip", "dst_ip", "dst_port", "inside")
              .agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("unanswered").alias("syn")))
    listed = bad_hosts.select("split", "src_ip").distinct().withColumn("listed", F.lit(True))
    windows = grid.to_windows(sliced).join(listed, ["split", "src_ip"], "left")

    def stats(rows: DataFrame, keys: list[str]) -> DataFrame:
        port = F.col("dst_port").cast("string")
        facet = F.explode(F.array(F.struct(F.lit(0).alias("facet"), F.col("dst_ip").alias("key")),
                                  F.struct(F.lit(1).alias("facet"), port.alias("key"))))
        keyed = (rows.select(*keys, "flows", "bytes", "syn", facet.alias("f")).select(*keys, "flows", "bytes", "syn", "f.*")
                 .groupBy(*keys, "facet", "key").agg(*(F.sum(c).alias(c) for c in ("flows", "bytes", "syn"))))
        peer = F.col("facet") == 0
        return keyed.groupBy(*keys).agg(
            F.sum(F.when(peer, F.col("flows"))).alias("flows"), F.count_if(~peer).alias("dst_ports"),
            F.count_if(peer).alias("dst_ips"), F.sum(F.when(peer, F.col("bytes"))).alias("bytes"),
            F.sum(F.when(peer, F.col("syn"))).alias("syn_unanswered"))

    names = ("flows", "dst_ports", "dst_ips", "bytes", "syn_unanswered")
    per_host = stats(windows.where("inside"), ["split", "w", "src_ip"])
    views = [
        stats(windows, ["split", "w"]).withColumn("view", F.lit("global")),
        per_host.groupBy("split", "w").agg(*(F.max(c).alias(c) for c in names)).withColumn("view", F.lit("perhost_max")),
        stats(windows.where("listed"), ["split", "w"]).withColumn("view", F.lit("listed")),
    ]
    kinds = grid.spine().drop("ts").select("split", "w", F.explode(F.array(
        F.lit("global"), F.lit("perhost_max"), F.lit("listed"))).alias("view"))
    stacked = views[0].unionByName(views[1]).unionByName(views[2])
    return kinds.join(stacked, ["split", "w", "view"], "left").fillna(0, list(names)).select(
        "split", "w", "view", *names)


def busiest_share(flows: DataFrame, grid: Grid, internal: tuple[str, ...], bad_hosts: DataFrame,
                  labels: DataFrame) -> DataFrame:
    """Share of windows whose busiest internal host is listed, by ``labels(split, w, y)``."""
    listed = bad_hosts.select("split", "src_ip").distinct().withColumn("listed", F.lit(True))
    hosts = host_windows(flows, grid, internal).join(listed, ["split", "src_ip"], "left")
    # busiest first; ties by address so the answer does not depend on row order
    first = F.min_by(F.coalesce(F.col("listed"), F.lit(False)), F.struct((-F.col("flows")).alias("f"), "src_ip"))
    busiest = hosts.groupBy("split", "w").agg(first.alias("hit"))
    return (labels.select("split", "w", "y").join(busiest, ["split", "w"], "left")
            .groupBy("split", "y").agg(F.count("*").alias("windows"),
                                       F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("int")).alias("busiest_share")))
