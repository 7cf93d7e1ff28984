"""The 70-column window state vector and window labels.

Shape of the plan: each family of columns is aggregated from the raw flows to (split, slice, key) with map-side
combining, the partial results are copied into windows, and small (split, w) tables meet in one final group-by.
No step sorts or multiplies raw flows except the beacon gaps, which are cut by time so that one busy pair is
spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import clean, entropy_bits, flow_shape
from tidewatch.functions.labels import effective_stage
from tidewatch.operators.grid import Grid, _div
from tidewatch.schema import BASE_FEATURES, IMPACT, RATE_BASES, STAGES, STATISTICS
from tidewatch.session import kept_apart

EDGE_KEYS = ["split", "slice_no", "n", "src_ip", "dst_ip", "dst_port"]
#: a window's beacon gaps are first taken inside this many pieces per slice
BEACON_PIECES = 16


def _merge_windows(grid: Grid, parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """Bring (split, w) tables with disjoint columns together: one union and one group-by instead of joins."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [grid.spine(), *parts])
    return stacked.groupBy("split", "w").agg(
        F.max("ts").alias("ts"), *(F.expr(f"coalesce(cast(max({c}) as double), 0.0D)").alias(c) for c in columns))


# --- A1-A3, A8: everything that merges by sum, min, max and moments --------------------------------------

def _slice_totals(flows: DataFrame, grid: Grid, internal: tuple[str, ...]) -> DataFrame:
    shape = flow_shape(internal)
    numeric = {col for col, _ in STATISTICS}
    value = {c: (shape[c].cast("double") if c in shape else clean(F.col(c))) for c in numeric}
    located = grid.locate(flows)
    aggs: list[Column] = [F.count("*").alias("n_flows")]
    aggs += [F.sum(shape[c]).alias(c) for c in ("bytes", "pkts", "outbound_bytes", "inbound_bytes")]
    aggs += [F.count_if(shape[c]).alias(f"r_{c}") for c in RATE_BASES]
    for col, how in STATISTICS:
        if how == "mean":
            aggs += [F.sum(value[col]).alias(f"s_{col}"), F.count(value[col]).alias(f"k_{col}")]
        elif how == "std":
            aggs += [F.var_pop(value[col]).alias(f"v_{col}")]
        else:
            aggs.append(getattr(F, how)(value[col]).alias(f"{how}_{col}"))
    return located.groupBy("split", "slice_no", "n").agg(*aggs)


def volume_features(flows: DataFrame, grid: Grid, internal: tuple[str, ...]) -> DataFrame:
    """A1 volume, A2 rates, A3 statistics, A8 direction: (split, w, ...), non-empty windows only."""
    rows = grid.to_windows(_slice_totals(flows, grid, internal))
    by_window = Window.partitionBy("split", "w")
    for col, how in STATISTICS:
        if how == "std":  # Chan's merge of slice moments around the window mean
            mean = F.sum(f"s_{col}").over(by_window) / F.sum(f"k_{col}").over(by_window)
            inner = F.col(f"s_{col}") / F.col(f"k_{col}") - mean
            rows = rows.withColumn(f"m2_{col}", F.col(f"k_{col}") * (F.col(f"v_{col}") + inner * inner))
    length = F.lit(grid.spec.length_s)
    total = F.sum("n_flows")
    out: list[Column] = [
        total.alias("n_flows"), (total / length).alias("flows_per_s"),
        F.sum("bytes").alias("bytes_total"), (F.sum("bytes") / length).alias("bytes_per_s"),
        F.sum("pkts").alias("pkts_total"), (F.sum("pkts") / length).alias("pkts_per_s"),
    ]
    out += [F.expr(f"sum(r_{c}) / sum(n_flows) as {c}_rate") for c in RATE_BASES]
    for col, how in STATISTICS:
        name = f"{col}_{how}"
        if how == "mean":
            out.append(F.expr(f"try_divide(sum(s_{col}), sum(k_{col})) as {name}"))
        elif how == "std":
            k = F.sum(f"k_{col}")
            out.append(F.when(k > 1, F.sqrt(F.sum(f"m2_{col}") / (k - 1))).alias(name))
        else:
            out.append(getattr(F, how)(f"{how}_{col}").alias(name))
    gone, come = F.sum("outbound_bytes"), F.sum("inbound_bytes")
    out += [gone.alias("outbound_bytes"), come.alias("inbound_bytes"),
            ((gone - come) / (gone + come + F.lit(1.0))).alias("byte_asymmetry")]
    return rows.groupBy("split", "w").agg(*out)


# --- A4-A7: who talks to whom ----------------------------------------------------------------------------

def edges(flows: DataFrame, grid: Grid) -> DataFrame:
    """Flows counted per (split, slice, source, destination, destination port)."""
    return (grid.locate(flows.select("split", "ts", "src_ip", "dst_ip", "dst_port"))
            .groupBy(*EDGE_KEYS).agg(F.count("*").alias("c")))


def spread_features(flows: DataFrame, grid: Grid) -> DataFrame:
    """A4 distinct counts (but source ports), A5 entropies, A6 fan-out.

    One edge row stands in four *facets*: its port, its destination, its (source, destination) and its
    (source, port). Counting facets by key, then by source, then by window gives every column in one pipeline.
    """
    windows = grid.to_windows(edges(flows, grid))
    nothing = F.lit(None).cast("string")
    port = F.col("dst_port").cast("string")
    facets = F.array(
        F.struct(F.lit(0).alias("facet"), nothing.alias("src"), port.alias("key")),
        F.struct(F.lit(1).alias("facet"), nothing.alias("src"), F.col("dst_ip").alias("key")),
        F.struct(F.lit(2).alias("facet"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("key")),
        F.struct(F.lit(3).alias("facet"), F.col("src_ip").alias("src"), port.alias("key")),
    )
    keyed = (windows.select("split", "w", "c", F.explode(facets).alias("f")).select("split", "w", "c", "f.*")
             .groupBy("split", "w", "facet", "src", "key").agg(F.sum("c").alias("c")))
    by_src = keyed.groupBy("split", "w", "facet", "src").agg(
        F.count("*").alias("keys"), F.sum("c").alias("flows"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))

    def only(facet: int, col) -> Column:
        return F.when(F.col("facet") == facet, col)

    flows_by_src = F.sum(only(2, F.col("flows")))
    return by_src.groupBy("split", "w").agg(
        F.count(only(2, F.col("flows"))).alias("uniq_src_ip"),
        F.sum(only(1, F.col("keys"))).alias("uniq_dst_ip"),
        F.sum(only(0, F.col("keys"))).alias("uniq_dst_port"),
        entropy_bits(F.sum(only(0, F.col("flows"))), F.sum(only(0, F.col("clogc")))).alias("dst_port_entropy"),
        entropy_bits(F.sum(only(1, F.col("flows"))), F.sum(only(1, F.col("clogc")))).alias("dst_ip_entropy"),
        entropy_bits(flows_by_src, F.sum(only(2, F.col("flows") * F.log2("flows")))).alias("src_ip_entropy"),
        F.max(only(2, F.col("keys"))).alias("fanout_max"),
        F.avg(only(2, F.col("keys"))).alias("fanout_mean"),
        F.max(only(3, F.col("keys"))).alias("port_fanout_max"),
        (F.max(only(2, F.col("flows"))) / flows_by_src).alias("top_talker_share"),
    )


def source_ports(flows: DataFrame, grid: Grid) -> DataFrame:
    """A4: distinct source ports per window, from distinct (slice, port) pairs (at most 65,536 a slice)."""
    seen = grid.locate(flows.select("split", "ts", "src_port")).select("split", "slice_no", "n", "src_port").distinct()
    return grid.to_windows(seen).groupBy("split", "w").agg(F.count_distinct("src_port").alias("uniq_src_port"))


def scan_features(flows: DataFrame, grid: Grid) -> DataFrame:
    """Share of neighbouring ports on a (source, destination) pair that differ by 1; widest pair.

    Neighbours in sorted order differ by 1 exactly when a port and its successor are both present, so no sort is
    needed: each port stands for itself and announces its successor, and a port that was announced is a hit. All
    of it happens where the pair's rows already are. ``c > 0`` always holds: it keeps the count in this branch so
    that its shuffle of edges is the very one ``spread_features`` makes (reused).
    """
    pair = ["split", "w", "src_ip", "dst_ip"]
    ports = grid.to_windows(edges(flows, grid).where(F.col("c") > 0)).select(*pair, "dst_port").repartition(*pair)
    both = F.explode(F.expr("array(struct(dst_port as port, true as here), struct(dst_port + 1 as port, false as here))"))
    met = ports.select(*pair, both.alias("p")).groupBy(*pair, "p.port").agg(
        F.bool_or("p.here").alias("here"), F.bool_or(~F.col("p.here")).alias("announced"))
    by_pair = met.groupBy(*pair).agg(
        F.count_if(F.col("here") & F.col("announced")).alias("seq"), F.count_if("here").alias("ports"))
    return by_pair.groupBy("split", "w").agg(
        F.coalesce(F.try_divide(F.sum("seq"), F.sum(F.col("ports") - 1)), F.lit(0.0)).alias("seq_port_ratio"),
        F.max("ports").alias("ports_per_pair_max"))


# --- A9: beacons ------------------------------------------------------------------------------------------

def beacon_features(flows: DataFrame, grid: Grid) -> DataFrame:
    """The most regular (source, destination) spacing of a window, 1 / (1 + std / mean of its gaps).

    Gaps are taken inside short pieces of time (so a pair with a third of all flows is many small sorts),
    each piece is kept as (count, first, last, sum of squared gaps), and pieces are stitched by the one gap
    between a piece's first flow and the previous piece's last. That gap belongs to the windows which hold both
    pieces, so pieces are put in order once per pair, not once per window.
    """
    spec = grid.spec
    pieces = BEACON_PIECES if spec.slice_us % BEACON_PIECES == 0 else 1
    piece_us = spec.slice_us // pieces
    pair = ["split", "n", "src_ip", "dst_ip", "piece"]
    located = grid.locate(flows.select("split", "ts", "src_ip", "dst_ip")).select(
        "split", "n", "src_ip", "dst_ip", _div(F.col("off_us"), piece_us).alias("piece"),
        (F.col("off_us") / F.lit(1e6)).alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(*pair).orderBy("at"))
    summary = (located.withColumn("gap", gap).groupBy(*pair)
               .agg(F.count("*").alias("c"), F.min("at").alias("first"), F.max("at").alias("last"),
                    F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("sq"))
               .withColumn("slice_no", _div(F.col("piece"), pieces)))
    along = Window.partitionBy("split", "src_ip", "dst_ip").orderBy("piece")
    linked = summary.withColumns({"prev_piece": F.lag("piece").over(along), "joint": F.col("first") - F.lag("last").over(along)})
    together = F.col("prev_piece") >= F.col("w") * F.lit(spec.slices_per_stride * pieces)
    stitched = grid.to_windows(linked).groupBy("split", "w", "src_ip", "dst_ip").agg(
        (F.sum("c") - 1).alias("gaps"), (F.max("last") - F.min("first")).alias("total"),
        (F.sum("sq") + F.coalesce(F.sum(F.when(together, F.col("joint") * F.col("joint"))), F.lit(0.0))).alias("sq"))
    enough = stitched.where(F.col("gaps") >= 3)
    mean = F.col("total") / F.col("gaps")
    var = (F.col("sq") - F.col("total") * mean) / (F.col("gaps") - 1)
    cv = F.sqrt(F.greatest(var, F.lit(0.0))) / (mean + F.lit(1e-6))
    return enough.groupBy("split", "w").agg(F.max(F.lit(1.0) / (F.lit(1.0) + cv)).alias("beacon_score"))


def state_vector(flows: DataFrame, grid: Grid, internal: tuple[str, ...], apart: bool = False) -> DataFrame:
    """The full base vector: (split, w, ts, 70 columns in frozen order), one row per window of the grid.

    ``apart`` makes one family after the other and writes its rows, few as they are, so that at no time the shuffles of
    all families lie on disk together.
    """
    families = [lambda: volume_features(flows, grid, internal), lambda: spread_features(flows, grid), lambda: source_ports(flows, grid),
                lambda: scan_features(flows, grid), lambda: beacon_features(flows, grid)]
    parts = [kept_apart(family()) if apart else family() for family in families]
    return _merge_windows(grid, parts, list(BASE_FEATURES)).select("split", "w", "ts", *BASE_FEATURES)


# --- A10-A12 ----------------------------------------------------------------------------------------------

def top_talkers(flows: DataFrame, grid: Grid, k: int = 3) -> DataFrame:
    """A10: the k busiest sources of each window (ties by address), as an ordered array of structs."""
    per_slice = (grid.locate(flows.select("split", "ts", "src_ip", "fwd_bytes", "bwd_bytes"))
                 .groupBy("split", "slice_no", "n", "src_ip")
                 .agg(F.count("*").alias("flows"), F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes_out")))
    per_window = grid.to_windows(per_slice).groupBy("split", "w", "src_ip").agg(
        F.sum("flows").alias("flows"), F.sum("bytes_out").alias("bytes_out"))
    order = Window.partitionBy("split", "w").orderBy(F.desc("flows"), "src_ip")
    top = per_window.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("src_ip").alias("ip"), "flows", "bytes_out")))
    return top.groupBy("split", "w").agg(
        F.transform(listed, lambda t: F.struct(t["ip"].alias("ip"), t["flows"].alias("flows"),
                                               t["bytes_out"].alias("bytes_out"))).alias("top_talkers"))


def stage_masks(flows: DataFrame, grid: Grid, include_attempted: bool = False) -> DataFrame:
    """Which stages a window holds, as a bit mask: one tiny mergeable number per slice."""
    bit = F.shiftleft(F.lit(1), 0)
    stage = effective_stage(include_attempted)
    for s in range(1, len(STAGES)):
        bit = F.when(stage == s, F.lit(1 << s)).otherwise(bit)
    per_slice = (grid.locate(flows.select("split", "ts", "stage", "attempted"))
                 .groupBy("split", "slice_no", "n").agg(F.bit_or(bit).alias("mask")))
    return grid.to_windows(per_slice).groupBy("split", "w").agg(F.bit_or("mask").alias("mask"))


def stage_from_mask(mask: Column) -> Column:
    """The most advanced progression stage above benign, else impact if present, else benign."""
    chain = None
    for s in range(IMPACT - 1, 0, -1):
        test = mask.bitwiseAND(F.lit(1 << s)) > 0
        chain = F.when(test, F.lit(s)) if chain is None else chain.when(test, F.lit(s))
    return chain.when(mask.bitwiseAND(F.lit(1 << IMPACT)) > 0, F.lit(IMPACT)).otherwise(F.lit(0))


def window_stages(flows: DataFrame, grid: Grid, include_attempted: bool = False) -> DataFrame:
    """A11 + A12: (split, w, stage, stage_<NAME> x 7) for every window of the grid."""
    masks = grid.fill(stage_masks(flows, grid, include_attempted), ["mask"], keep_ts=False)
    hostile = F.col("mask").bitwiseAND(F.lit((1 << len(STAGES)) - 2))
    flags = [(hostile == 0).cast("int").alias("stage_BENIGN")]
    flags += [(hostile.bitwiseAND(F.lit(1 << s)) > 0).cast("int").alias(f"stage_{STAGES[s]}")
              for s in range(1, len(STAGES))]
    return masks.select("split", "w", stage_from_mask(F.col("mask")).alias("stage"), *flags)
