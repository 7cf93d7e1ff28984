"""Queries for windows, projections, the state vector, optional blocks and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import INTERNAL, K, SPEC, comparable, cte, flows, grid_of, labelled_states, q, stages, table
from tidewatch.functions import columns, labels
from tidewatch.operators import blocks, grid, state, targets
from tidewatch.schema import (BASE_FEATURES, FLOW_PACKET_FEATURES, HOST_RELATIVE_FEATURES, RATE_BASES, SERVICE_PORTS,
                              STAGES, STATISTICS, TREND_BASES, TREND_FEATURES, host_slot_names)

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- oracle text for the state vector --------------------------------------------------------------------

_FLAG = {
    "syn_no_ack": "syn_cnt > 0 and ack_cnt = 0", "has_rst": "rst_cnt > 0", "has_fin": "fin_cnt > 0",
    "one_way": "bwd_pkts = 0", "tiny_flow": "fwd_pkts + bwd_pkts <= 2", "priv_port": "dst_port < 1024",
    "ephemeral_dst": "dst_port >= 32768", "is_outbound": "si and not di", "is_inbound": "not si and di",
    "is_internal": "si and di", "proto_tcp": "protocol = 6", "proto_udp": "protocol = 17", "proto_icmp": "protocol = 1",
    **{f"svc_{n}": f"dst_port in ({', '.join(map(str, p))})" for n, p in SERVICE_PORTS.items()},
}
_VALUE = {"duration_s": "duration_us / 1e6", "bytes": "(fwd_bytes + bwd_bytes)", "pkts": "(fwd_pkts + bwd_pkts)"}
_HOW = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp", "sum": "sum"}
cte("dx", "select *, starts_with(src_ip, '192.168.10.') as si, starts_with(dst_ip, '192.168.10.') as di from ex")
cte("vol", "select split, w, count(*) as n_flows, count(*) / 3600.0 as flows_per_s, sum(fwd_bytes + bwd_bytes) as bytes_total, "
    "sum(fwd_bytes + bwd_bytes) / 3600.0 as bytes_per_s, sum(fwd_pkts + bwd_pkts) as pkts_total, "
    "sum(fwd_pkts + bwd_pkts) / 3600.0 as pkts_per_s, "
    + ", ".join(f"avg(case when {_FLAG[b]} then 1.0 else 0.0 end) as {b}_rate" for b in RATE_BASES) + ", "
    + ", ".join(f"{_HOW[h]}({_VALUE.get(c, c)}) as {c}_{h}" for c, h in STATISTICS)
    + ", sum(case when si and not di then fwd_bytes when not si and di then bwd_bytes else 0 end) as outbound_bytes, "
    "sum(case when si and not di then bwd_bytes when not si and di then fwd_bytes else 0 end) as inbound_bytes, "
    "count(distinct src_ip) as uniq_src_ip, count(distinct dst_ip) as uniq_dst_ip, count(distinct dst_port) as uniq_dst_port, "
    "count(distinct src_port) as uniq_src_port, entropy(dst_port) as dst_port_entropy, entropy(dst_ip) as dst_ip_entropy, "
    "entropy(src_ip) as src_ip_entropy from dx group by split, w")
cte("per_src", "select split, w, src_ip, count(distinct dst_ip) as f, count(distinct dst_port) as p, count(*) as c from ex group by all")
cte("fan", "select split, w, max(f) as fanout_max, avg(f) as fanout_mean, max(p) as port_fanout_max, max(c) / sum(c) as top_talker_share "
           "from per_src group by split, w")
cte("pairport", "select distinct split, w, src_ip, dst_ip, dst_port from ex")
cte("steps", "select *, dst_port - lag(dst_port) over (partition by split, w, src_ip, dst_ip order by dst_port) as step from pairport")
cte("perpair", "select split, w, src_ip, dst_ip, count(*) as ports, count(step) as steps, count(*) filter (where step = 1) as seq "
               "from steps group by all")
cte("scan", "select split, w, case when sum(steps) > 0 then sum(seq) / sum(steps) else 0 end as seq_port_ratio, "
            "max(ports) as ports_per_pair_max from perpair group by split, w")
cte("gaps", "select split, w, src_ip, dst_ip, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by split, w, src_ip, dst_ip order by ts)) / 1e6 as gap from ex")
cte("pairgap", "select split, w, avg(gap) as m, stddev_samp(gap) as sd, count(gap) as c from gaps group by split, w, src_ip, dst_ip")
cte("beacon", "select split, w, max(1 / (1 + sd / (m + 1e-6))) as beacon_score from pairgap where c >= 3 group by split, w")
_plain = [c for c in BASE_FEATURES if c != "byte_asymmetry"]
cte("vec", "select sp.split, sp.w, sp.ts_us, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _plain)
    + ", coalesce((outbound_bytes - inbound_bytes) / (outbound_bytes + inbound_bytes + 1.0), 0) as byte_asymmetry from sp "
      "left join vol using (split, w) left join fan using (split, w) left join scan using (split, w) left join beacon using (split, w)")


def _features(names):
    return table(q(f"select split, w, {', '.join(names)} from vec"), s="split", i="w", d=" ".join(names))


def _vector(spark, sf):
    rows = flows(spark, sf)
    return state.state_vector(rows, grid_of(rows), INTERNAL)


@query("state_vector", table(q("select * from vec"), s="split", i="w ts_us", d=" ".join(BASE_FEATURES)))
def state_vector(spark, sf):
    return _vector(spark, sf).withColumnRenamed("ts", "ts_us")


@query("first_slice", table(q("select sp.split, sp.w, coalesce(n_flows, 0) as n_flows, coalesce(bytes_total, 0) as bytes_total, "
                              "coalesce(uniq_src_ip, 0) as uniq_src_ip, coalesce(uniq_dst_port, 0) as uniq_dst_port, "
                              "coalesce(dst_port_entropy, 0) as dst_port_entropy, stage from sp left join vol using (split, w) "
                              "join st using (split, w)"),
                            s="split", i="w n_flows bytes_total uniq_src_ip uniq_dst_port stage", d="dst_port_entropy"))
def first_slice(spark, sf):
    """The flagship: flows -> labels -> windows -> counts, spread and stage per window."""
    rows = flows(spark, sf)
    g = grid_of(rows)
    counts = g.to_windows(g.locate(rows.select("split", "ts", "fwd_bytes", "bwd_bytes")).groupBy("split", "slice_no", "n").agg(
        F.count("*").alias("n_flows"), F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes_total")))
    counts = counts.groupBy("split", "w").agg(F.sum("n_flows").alias("n_flows"), F.sum("bytes_total").alias("bytes_total"))
    spread = state.spread_features(rows, g).select("split", "w", "uniq_src_ip", "uniq_dst_port", "dst_port_entropy")
    staged = state.window_stages(rows, g).select("split", "w", "stage")
    out = staged.join(counts, ["split", "w"], "left").join(spread, ["split", "w"], "left")
    return out.fillna(0).select("split", "w", F.col("n_flows"), F.col("bytes_total"), F.col("uniq_src_ip"),
                                F.col("uniq_dst_port"), "dst_port_entropy", "stage")


@query("window_grid", table(q("select split, t0_us, n from gr"), s="split", i="t0_us n"))
def window_grid(spark, sf):
    return grid_of(flows(spark, sf)).spans


@query("window_expand", table(q("select split, w, flow_id from ex"), s="split", i="w flow_id"))
def window_expand(spark, sf):
    rows = flows(spark, sf)
    return grid_of(rows).expand(rows.select("split", "ts", "flow_id")).select("split", "w", "flow_id")


@query("window_spine_fill", table(q("select sp.split, sp.w, sp.ts_us, coalesce(c, 0) as n_flows, coalesce(bad, 0) as n_attacks from sp left join "
                                    "(select split, w, count(*) as c, count(*) filter (where stage > 0) as bad from ex group by split, w) using (split, w)"),
                                  s="split", i="w ts_us n_flows n_attacks"))
def window_spine_fill(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    hits = g.locate(rows.select("split", "ts", "stage")).groupBy("split", "slice_no", "n").agg(F.count("*").alias("c"), F.count_if(F.col("stage") > 0).alias("bad"))
    counts = g.to_windows(hits).groupBy("split", "w").agg(F.sum("c").alias("n_flows"), F.sum("bad").alias("n_attacks"))
    return g.fill(counts, ["n_flows", "n_attacks"]).withColumnRenamed("ts", "ts_us")


@query("window_sliced", table(q("select split, w, count(*) as c from (select *, unnest(generate_series(greatest(0, cast(floor((off_us - "
                                "4500000000) / 1800000000.0) as bigint) + 1), off_us // 1800000000)) as w from ex0) group by split, w"),
                              s="split", i="w c"))
def window_sliced(spark, sf):
    """A length that is not a multiple of the stride: slices of 900 s."""
    rows = flows(spark, sf)
    g = grid.Grid.fit(rows, grid.WindowSpec(4500, 1800))
    sliced = g.locate(rows.select("split", "ts")).groupBy("split", "slice_no", "n").agg(F.count("*").alias("c"))
    return g.to_windows(sliced).groupBy("split", "w").agg(F.sum("c").alias("c"))


@query("grid_alignment", table(q("select split, 0 as offset_windows from gr"), s="split", i="offset_windows"))
def grid_alignment(spark, sf):
    spans = grid_of(flows(spark, sf)).spans.select("split", F.timestamp_micros("t0_us").alias("t0"))
    return grid.grid_offset(SPEC, spans, spans)


@query("conservation", table(q("select split, count(distinct flow_id) as flows, count(*) as memberships, count(*) as window_flows, "
                               "1 as conserved from ex group by split"), s="split", i="flows memberships window_flows conserved"))
def conservation(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    return grid.conservation(rows, state.volume_features(rows, g, INTERNAL), g)


# ---- projections and labels ------------------------------------------------------------------------------

_TEXT = ("trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '\\battempt(ed)?\\b', ' ', 'g'), "
         "'[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g'))")
_INFO = "case label when 'BENIGN' then ['', '', ''] when 'Portscan' then ['TA0043', 'T1595.001', 'Active Scanning: Scanning IP Blocks'] " \
        "when 'FTP-Patator - Attempted' then ['TA0001', 'T1110.001', 'Brute Force: Password Guessing'] " \
        "when 'Infiltration - Portscan' then ['TA0008', 'T1046', 'Network Service Discovery'] " \
        "when 'Botnet' then ['TA0011', 'T1071.001', 'Application Layer Protocol: Web Protocols'] " \
        "when 'DDoS' then ['TA0040', 'T1498', 'Network Denial of Service'] end"


@query("label_map", table(q(f"select flow_id, label, {_TEXT} as normal, case label when 'Infiltration - Portscan' then 3 else stage end as label_stage, "
                            f"stage, attempted, ({_INFO})[1] as tactic, ({_INFO})[2] as technique, ({_INFO})[3] as technique_name from fx"),
                          s="label normal tactic technique technique_name", i="flow_id label_stage stage attempted"))
def label_map(spark, sf):
    rows = flows(spark, sf).select("flow_id", "label", "src_ip")
    info = labels.map_distinct(rows, "label", labels.map_label(F.col("label")), "m")
    refined = labels.refine_scan_direction(F.col("label"), F.col("m.stage"), F.col("src_ip"), INTERNAL)
    return info.select("flow_id", "label", labels.normalise_label(F.col("label")).alias("normal"),
                       F.col("m.stage").alias("label_stage"), refined.alias("stage"), F.col("m.attempted").alias("attempted"),
                       "m.tactic", "m.technique", "m.technique_name")


_CTU = "case when flow_id % 5 = 0 then 'flow=Background' when flow_id % 5 = 1 then 'flow=From-Botnet-V42-TCP-CC1-HTTP' " \
       "when flow_id % 5 = 2 then 'flow=From-Botnet-V42-UDP-Attempt' when flow_id % 5 = 3 then 'flow=From-Botnet-V42-TCP-Attempt-SPAM' " \
       "else 'flow=From-Botnet-V42-UDP-DNS' end"
_STATE = "case when flow_id % 4 = 0 then 'S_' when flow_id % 4 = 1 then 'FSPA_FSA' when flow_id % 4 = 2 then 'INT' else 'S_RA' end"
_PORT = "case when flow_id % 4 = 0 then concat('0x', lower(to_hex(dst_port))) when flow_id % 4 = 1 then '' else cast(dst_port as varchar) end"


@query("biflow_columns", table(q(
    "select flow_id, stage, port, fwd, case when rep then greatest(tot - fwd, 1) else 0 end as bwd, syn, fin from ("
    "select *, case when rep then cast(least(greatest(round_even(tot * share, 0), 1), greatest(tot - 1, 1)) as bigint) else tot end as fwd from ("
    "select flow_id, case flow_id % 5 when 0 then 0 when 1 then 4 when 2 then 1 when 3 then 6 else 4 end as stage, "
    "case when flow_id % 4 = 1 then 0 else dst_port end as port, fwd_pkts + bwd_pkts as tot, "
    "case when fwd_bytes + bwd_bytes > 0 then fwd_bytes / (fwd_bytes + bwd_bytes) else 1 end as share, "
    "case when protocol = 6 then flow_id % 4 in (1, 3) else flow_id % 4 <> 2 end as rep, "
    "case flow_id % 4 when 0 then 1 when 1 then 2 when 2 then 0 else 1 end as syn, case flow_id % 4 when 1 then 2 else 0 end as fin from fx))"),
    i="flow_id stage port fwd bwd syn fin"))
def biflow_columns(spark, sf):
    rows = flows(spark, sf).withColumns({
        "state": F.expr(_STATE), "blabel": F.expr(_CTU),
        "port_text": F.expr("case when flow_id % 4 = 0 then concat('0x', lower(hex(dst_port))) when flow_id % 4 = 1 then '' "
                            "else cast(dst_port as string) end")})
    total, total_bytes = F.col("fwd_pkts") + F.col("bwd_pkts"), F.col("fwd_bytes") + F.col("bwd_bytes")
    forward, backward = columns.biflow_packets(total, total_bytes, F.col("fwd_bytes"),
                                               columns.biflow_replied(F.col("state"), F.col("protocol")))
    return rows.select("flow_id", labels.biflow_stage(F.col("blabel")).alias("stage"),
                       columns.parse_port(F.col("port_text")).alias("port"), forward.alias("fwd"), backward.alias("bwd"),
                       columns.flag_sides(F.col("state"), "S").alias("syn"), columns.flag_sides(F.col("state"), "F").alias("fin"))


_SHAPE = ["pkts", "bytes", "outbound_bytes", "inbound_bytes"]


@query("flow_shape", table(q("select flow_id, fwd_pkts + bwd_pkts as pkts, fwd_bytes + bwd_bytes as bytes, "
                             "case when si and not di then fwd_bytes when not si and di then bwd_bytes else 0 end as outbound_bytes, "
                             "case when si and not di then bwd_bytes when not si and di then fwd_bytes else 0 end as inbound_bytes, "
                             "duration_us / 1e6 as duration_s, " + ", ".join(f"({_FLAG[b]}) as {b}" for b in RATE_BASES)
                             + " from (select *, starts_with(src_ip, '192.168.10.') as si, starts_with(dst_ip, '192.168.10.') as di from fx)"),
                           i="flow_id " + " ".join(_SHAPE) + " " + " ".join(RATE_BASES), d="duration_s"))
def flow_shape(spark, sf):
    shape = columns.flow_shape(INTERNAL)
    return flows(spark, sf).select("flow_id", *(shape[c].alias(c) for c in [*_SHAPE, *RATE_BASES, "duration_s"]))


@query("flagged_flows", table(q(
    "select flow_id, stage, score from (select flow_id, stage, max(flows_per_s) as score from ex join vol using (split, w) "
    "where stage = 1 group by flow_id, stage) where score >= 0.002 order by score desc, flow_id limit 50"), i="flow_id stage", d="score"))
def flagged_flows(spark, sf):
    """Flows of one stage with their strongest window score, best 50 (a top-k report)."""
    from tidewatch.operators.reports import flagged_flows as flagged
    rows = flows(spark, sf)
    g = grid_of(rows)
    scores = state.volume_features(rows, g, INTERNAL).select("split", "w", F.col("flows_per_s").alias("score"))
    return flagged(rows, scores, g, stage=1, min_score=0.002).select("flow_id", "stage", "score")


# ---- state-vector families -------------------------------------------------------------------------------

@query("volume_features", _features(BASE_FEATURES[:53]).replace(" from vec", " from vec where n_flows > 0"))
def volume_features(spark, sf):
    rows = flows(spark, sf)
    return state.volume_features(rows, grid_of(rows), INTERNAL).select(
        "split", "w", *(F.col(c).cast("double").alias(c) for c in BASE_FEATURES[:53]))


_SPREAD = ["uniq_src_ip", "uniq_dst_ip", "uniq_dst_port", "dst_port_entropy", "dst_ip_entropy", "src_ip_entropy",
           "fanout_max", "fanout_mean", "port_fanout_max", "top_talker_share"]


@query("spread_features", _features(_SPREAD).replace(" from vec", " from vec where n_flows > 0"))
def spread_features(spark, sf):
    rows = flows(spark, sf)
    return state.spread_features(rows, grid_of(rows)).select("split", "w", *(F.col(c).cast("double").alias(c) for c in _SPREAD))


@query("source_ports", table(q("select split, w, uniq_src_port from vol"), s="split", i="w uniq_src_port"))
def source_ports(spark, sf):
    rows = flows(spark, sf)
    return state.source_ports(rows, grid_of(rows))


@query("scan_features", table(q("select * from scan"), s="split", i="w ports_per_pair_max", d="seq_port_ratio"))
def scan_features(spark, sf):
    rows = flows(spark, sf)
    return state.scan_features(rows, grid_of(rows))


# day-long windows, in which pairs of the fixture do meet often enough to have a spacing
cte("exd", "select *, unnest(generate_series(greatest(0, off_us // 43200000000 - 1), off_us // 43200000000)) as dw from ex0")
cte("gapsd", "select split, dw, src_ip, dst_ip, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by split, dw, src_ip, dst_ip order by ts)) / 1e6 as gap from exd")
cte("pairgapd", "select split, dw, avg(gap) as m, stddev_samp(gap) as sd, count(gap) as c from gapsd group by split, dw, src_ip, dst_ip")


@query("beacon_features", table(q("select split, dw as w, max(1 / (1 + sd / (m + 1e-6))) as beacon_score from pairgapd where c >= 3 group by split, dw"), s="split", i="w", d="beacon_score"))
def beacon_features(spark, sf):
    rows = flows(spark, sf)
    return state.beacon_features(rows, grid.Grid.fit(rows, grid.WindowSpec(86400, 43200)))


@query("top_talkers", table(q("select split, w, src_ip as ip, r as rank, c as flows, b as bytes_out from (select split, w, src_ip, count(*) as c, "
                              "sum(fwd_bytes + bwd_bytes) as b, row_number() over (partition by split, w order by count(*) desc, src_ip) as r "
                              "from ex group by split, w, src_ip) where r <= 3"), s="split ip", i="w rank flows bytes_out"))
def top_talkers(spark, sf):
    rows = flows(spark, sf)
    top = state.top_talkers(rows, grid_of(rows))
    return top.select("split", "w", F.posexplode("top_talkers").alias("p", "t")).select(
        "split", "w", F.col("t.ip").alias("ip"), (F.col("p") + 1).alias("rank"), "t.flows", "t.bytes_out")


_ST = " ".join(f"stage_{n}" for n in STAGES)


@query("window_stages", table(q("select split, w, stage, case when s1+s2+s3+s4+s5+s6 = 0 then 1 else 0 end as stage_BENIGN, "
                                + ", ".join(f"s{i} as stage_{STAGES[i]}" for i in range(1, 7)) + " from st"),
                              s="split", i="w stage " + _ST))
def window_stages(spark, sf):
    return stages(spark, sf)


# ---- optional blocks -------------------------------------------------------------------------------------

def _trend_sql():
    cols = []
    for b in TREND_BASES:
        cols.append(f"coalesce({b} - lag({b}) over o, 0) as {b}_delta")
        for n in (5, 10):
            f = f"(partition by split order by w rows between {n - 1} preceding and current row)"
            cols.append(f"case when count(*) over {f} = {n} then regr_slope({b}, w) over {f} else 0 end as {b}_slope_{n}")
        f = "(partition by split order by w rows between 120 preceding and 1 preceding)"
        cols.append(f"case when count({b}) over {f} >= 10 then greatest(least(({b} - avg({b}) over {f}) / "
                    f"greatest(stddev_samp({b}) over {f}, 1e-6), 10), -10) else 0 end as {b}_zscore")
    return table(q(f"select split, w, {', '.join(cols)} from vec window o as (partition by split order by w)"),
                 s="split", i="w", d=" ".join(TREND_FEATURES))


@query("trend_features", _trend_sql())
def trend_features(spark, sf):
    return blocks.trend_features(_vector(spark, sf)).select("split", "w", *TREND_FEATURES)


cte("hostw", "select split, w, src_ip, count(*) as flows, count(distinct dst_ip) as fanout, count(distinct dst_port) as ports, "
             "sum(fwd_bytes) as sent, sum(bwd_bytes) as received from inx group by split, w, src_ip")
cte("firstpair", "select split, src_ip, dst_ip, min(w) as w from inx group by all")
cte("freshpair", "select split, src_ip, w, count(*) as fresh from firstpair group by all")
cte("slotted", "select *, row_number() over (partition by split, w order by flows desc, src_ip) as slot from hostw left join freshpair using (split, src_ip, w)")


@query("host_slots", table(q("select sp.split, sp.w, " + ", ".join(
    f"coalesce(max(case when slot = {i} then {v} end), 0) as host{i}_{n}" for i in (1, 2, 3) for n, v in (
        ("fanout", "fanout"), ("ports", "ports"), ("byte_asym", "(sent - received) / (sent + received + 1.0)"),
        ("new_peer_rate", "coalesce(fresh, 0) / fanout")))
    + " from sp left join slotted using (split, w) group by sp.split, sp.w"), s="split", i="w", d=" ".join(host_slot_names(3))))
def host_slots(spark, sf):
    rows = flows(spark, sf)
    return blocks.host_slots(rows, grid_of(rows), INTERNAL, 3)


_BIN = "(case when pkt_len_mean >= 0.5 then 1 else 0 end + case when pkt_len_mean >= 64.5 then 1 else 0 end + " \
       "case when pkt_len_mean >= 512.5 then 1 else 0 end + case when pkt_len_mean >= 1024.5 then 1 else 0 end)"
_FP = {
    "pkt_win_zero_rate": "avg(case when protocol = 6 then case when fwd_init_win = 0 then 1.0 else 0.0 end end)",
    "pkt_win_small_rate": "avg(case when protocol = 6 then case when fwd_init_win > 0 and fwd_init_win < 1024 then 1.0 else 0.0 end end)",
    "pkt_win_distinct": "count(distinct case when protocol = 6 then fwd_init_win end)",
    "pkt_win_entropy": "entropy(fwd_init_win) filter (where protocol = 6)",
    **{f"pkt_payload_{n}_rate": f"sum(case when {_BIN} = {b} then fwd_pkts + bwd_pkts else 0 end) / sum(fwd_pkts + bwd_pkts)"
       for b, n in enumerate(("0", "1_64", "65_512", "513_1024", "gt1024"))},
    "pkt_fwd_len_std_mean": "avg(fwd_pkt_len_std)", "pkt_bwd_len_std_mean": "avg(bwd_pkt_len_std)",
    "pkt_fwd_iat_std_mean": "avg(fwd_iat_std)", "pkt_bwd_iat_std_mean": "avg(bwd_iat_std)",
    "pkt_iat_cv_median": "median(case when fwd_pkts + bwd_pkts >= 3 and flow_iat_mean > 0 then flow_iat_std / flow_iat_mean end)",
    "pkt_bwd_rst_rate": "avg(case when bwd_rst_cnt > 0 then 1.0 else 0.0 end)",
    "pkt_syn_probe_rate": "avg(case when protocol = 6 and syn_cnt > 0 and fwd_pkts <= 2 and fwd_data_pkts = 0 then 1.0 else 0.0 end)",
    "pkt_fwd_hdr_per_pkt_mean": "avg(case when protocol = 6 and fwd_pkts > 0 then fwd_hdr_bytes / fwd_pkts end)",
}


@query("flow_packet_features", table(q("select sp.split, sp.w, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in FLOW_PACKET_FEATURES)
                                       + " from sp left join (select split, w, " + ", ".join(f"{v} as {c}" for c, v in _FP.items())
                                       + " from ex group by split, w) using (split, w)"),
                                     s="split", i="w", d=" ".join(FLOW_PACKET_FEATURES)))
def flow_packet_features(spark, sf):
    rows = flows(spark, sf)
    return blocks.flow_packet_features(rows, grid_of(rows), INTERNAL)


cte("dense", "select h.split, h.src_ip, sp.w, coalesce(flows, 0) as flows, coalesce(fanout, 0) as fanout, coalesce(ports, 0) as ports "
             "from (select distinct split, src_ip from inx) h join sp using (split) left join hostw using (split, src_ip, w)")
_F = "(partition by split, src_ip order by w rows between 120 preceding and 1 preceding)"
cte("relz", "select split, w, " + ", ".join(
    f"case when count(*) over {_F} >= 10 then greatest(least(({c} - avg({c}) over {_F}) / greatest(stddev_samp({c}) over {_F}, 1.0), 10), -10) end as {c}_z"
    for c in ("ports", "fanout")) + f", case when count(*) over {_F} >= 10 then flows / (1.0 + avg(flows) over {_F}) end as ratio from dense")
cte("firstport", "select split, src_ip, dst_port, min(w) as w from inx group by all")
cte("firsthost", "select split, src_ip, min(w) as w0 from inx group by all")


@query("host_relative_features", table(q(
    "select sp.split, sp.w, coalesce(pz, 0) as hostrel_ports_z_max, coalesce(fz, 0) as hostrel_fanout_z_max, coalesce(rt, 0) as hostrel_flows_ratio_max, "
    "coalesce(np, 0) as hostrel_new_peer_hosts, coalesce(nx, 0) as hostrel_new_ports_max, coalesce(nh, 0) as hostrel_new_hosts from sp "
    "left join (select split, w, max(ports_z) as pz, max(fanout_z) as fz, max(ratio) as rt from relz group by split, w) using (split, w) "
    "left join (select split, w, count(distinct src_ip) as np from firstpair join firsthost using (split, src_ip) where w > w0 group by split, w) using (split, w) "
    "left join (select split, w, max(c) as nx from (select split, src_ip, w, count(*) as c from firstport join firsthost using (split, src_ip) "
    "where w > w0 group by all) group by split, w) using (split, w) "
    "left join (select split, w0 as w, count(*) as nh from firsthost group by all) using (split, w)"),
    s="split", i="w", d=" ".join(HOST_RELATIVE_FEATURES)))
def host_relative_features(spark, sf):
    rows = flows(spark, sf)
    return blocks.host_relative_features(rows, grid_of(rows), INTERNAL)


def _segment(side):
    return (f"select o.split, o.onset_w, '{side}' as side, {side} as host, " + ", ".join(
        f"coalesce(sum(case when x.w >= o.onset_w + {a} and x.w < o.onset_w + {b} then c end), 0) / {float(b - a)} as {n}"
        for n, a, b in (("baseline", -30, -10), ("run_up", -10, 0), ("after", 2, 20)))
        + f" from (select split, w, {side}, count(distinct dst_port) as c from ex where stage = 0 group by all) x "
          "join ons_a o on o.split = x.split and x.w >= o.onset_w - 30 and x.w < o.onset_w + 20 group by all")


def _contributions():
    return table(q(f"select *, run_up - baseline as delta from ({_segment('src_ip')} union all {_segment('dst_ip')})"),
                 s="split side host", i="onset_w", d="baseline run_up after delta")


def segment_contributions(spark, sf):
    """Around every onset of every split."""
    rows = flows(spark, sf)
    g = grid_of(rows)
    onset_table = targets.episode_onsets(state.window_stages(rows, g))
    return blocks.onset_contributions(rows, g, onset_table, horizon=10, baseline=20, after=20)


_BAD = "select distinct split, src_ip from fx where label = 'Botnet'"
_VIEWSTATS = "count(*) as flows, count(distinct dst_port) as dst_ports, count(distinct dst_ip) as dst_ips, sum(fwd_bytes + bwd_bytes) as bytes, " \
             "sum(case when protocol = 6 and syn_cnt > 0 and bwd_pkts = 0 then 1 else 0 end) as syn_unanswered"
_VS = ("flows", "dst_ports", "dst_ips", "bytes", "syn_unanswered")


@query("host_views", table(q(
    f"select sp.split, sp.w, v.view, {', '.join(f'coalesce({c}, 0) as {c}' for c in _VS)} from sp cross join "
    f"(values ('global'), ('perhost_max'), ('listed')) v(view) left join ("
    f"select split, w, 'global' as view, {_VIEWSTATS} from ex group by split, w union all "
    f"select split, w, 'perhost_max', {', '.join(f'max({c})' for c in _VS)} from (select split, w, src_ip, {_VIEWSTATS} from inx group by split, w, src_ip) group by split, w union all "
    f"select split, w, 'listed', {_VIEWSTATS} from ex join ({_BAD}) using (split, src_ip) group by split, w) x on x.split = sp.split and x.w = sp.w and x.view = v.view"),
    s="split view", i="w " + " ".join(_VS)))
def host_views(spark, sf):
    rows = flows(spark, sf)
    return blocks.host_views(rows, grid_of(rows), INTERNAL, rows.where("label = 'Botnet'").select("split", "src_ip"))


@query("busiest_share", table(q(
    f"select split, y, count(*) as windows, avg(coalesce(hit, 0)) as busiest_share from (select split, w, case when stage > 0 then 1 else 0 end as y from st) "
    f"left join (select split, w, case when b.src_ip is null then 0 else 1 end as hit from (select *, row_number() over (partition by split, w order by flows desc, src_ip) as r from hostw) h "
    f"left join ({_BAD}) b using (split, src_ip) where r = 1) using (split, w) group by split, y"), s="split", i="y windows", d="busiest_share"))
def busiest_share(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    y = state.window_stages(rows, g).select("split", "w", (F.col("stage") > 0).cast("int").alias("y"))
    return blocks.busiest_share(rows, g, INTERNAL, rows.where("label = 'Botnet'").select("split", "src_ip"), y)


# ---- targets and episodes --------------------------------------------------------------------------------

cte("prg", "select *, case when stage < 6 then stage else 0 end as prog, case when stage between 3 and 5 then 1 else 0 end as compromise, "
           "case when stage > 0 then 1 else 0 end as attack_now from st")
cte("stp", "select *, case when prog > lag(prog) over (partition by split order by w) then 1 else 0 end as escalate_step from prg")
_AH = "(partition by split order by w rows between 1 following and 10 following)"
cte("tgt", "select *, " + ", ".join(
    f"coalesce(lead(compromise, {k}) over o, 0) as hazard_k{k}, coalesce(lead(attack_now, {k}) over o, 0) as attack_k{k}, "
    f"case when lead(prog, {k}) over o > prog then 1 else 0 end as escalate_k{k}" for k in range(1, 11))
    + f", coalesce(max(compromise) over {_AH}, 0) as y_within_K, coalesce(max(attack_now) over {_AH}, 0) as y_attack_within_K, "
      f"coalesce(max(escalate_step) over {_AH}, 0) as y_escalate_within_K from stp window o as (partition by split order by w)")
_T = ("stage compromise attack_now escalate_step y_within_K y_attack_within_K y_escalate_within_K "
      + " ".join(f"hazard_k{k} attack_k{k} escalate_k{k}" for k in range(1, 11)))


@query("targets", table(q("select * from tgt"), s="split", i="w " + _T))
def all_targets(spark, sf):
    return labelled_states(spark, sf).select("split", "w", *_T.split())


@query("masked_within", table(q(f"select split, w, coalesce(max(attack_now) over {_AH}, 0) as target, w < count(*) over (partition by split) - 10 as full_future from prg"),
                              s="split", i="w target full_future"))
def masked_within(spark, sf):
    return targets.masked_within(labelled_states(spark, sf), "attack_now", K).select("split", "w", "target", "full_future")


_NAME = "['BENIGN', 'RECONNAISSANCE', 'INITIAL_ACCESS', 'LATERAL_MOVEMENT', 'COMMAND_AND_CONTROL', 'EXFILTRATION', 'IMPACT'][stage + 1]"
cte("ons_a", f"select split, w as onset_w, stage, {_NAME} as family from (select *, w - lag(w) over (partition by split order by w) as d from st where stage > 0) where d is null or d > 4")
cte("ons_c", f"select split, w as onset_w, stage, {_NAME} as family from (select *, w - lag(w) over (partition by split order by w) as d from st where stage between 3 and 5) where d is null or d > 4")


query("segment_contributions", _contributions())(segment_contributions)


@query("episode_onsets", table(q("select 'attack' as source, * from ons_a union all select 'compromise', * from ons_c"), s="source split family", i="onset_w stage"))
def episode_onsets(spark, sf):
    s = stages(spark, sf)
    return targets.episode_onsets(s, "attack").withColumn("source", F.lit("attack")).unionByName(
        targets.episode_onsets(s, "compromise").withColumn("source", F.lit("compromise")))


@query("onsets_without_impact", table(q("select * from ons_a where family <> 'IMPACT'"), s="split family", i="onset_w stage"))
def onsets_without_impact(spark, sf):
    return targets.without_family(targets.episode_onsets(stages(spark, sf)), "IMPACT")


cte("epi", f"select st.split, st.w, st.stage, case when o.onset_w is null then 0 else 1 end as onset_now, st.stage = 0 as eligible from st left join ons_a o on o.split = st.split and o.onset_w = st.w")
cte("epl", f"select *, case when stage = 0 and coalesce(max(onset_now) over {_AH}, 0) > 0 then 1 else 0 end as precursor from epi")


@query("episode_labels", table(q("select * from epl"), s="split", i="w onset_now precursor eligible"))
def episode_labels(spark, sf):
    return targets.episode_labels(stages(spark, sf), K).select("split", "w", "onset_now", "precursor", "eligible")


cte("quiet", "select o.split, o.onset_w, o.family, coalesce(o.onset_w - max(st.w) - 1, o.onset_w) as quiet_windows from ons_a o "
             "left join st on st.split = o.split and st.w < o.onset_w and st.stage > 0 group by o.split, o.onset_w, o.family")


@query("quiet_before", table(q("select * from quiet"), s="split family", i="onset_w quiet_windows"))
def quiet_before(spark, sf):
    s = stages(spark, sf)
    return targets.quiet_before(s, targets.episode_onsets(s)).drop("stage")


@query("stage_spans", table(q(
    "select split, start_w, end_w, stage, label from (select s.split, s.start_w, s.end_w, s.stage, ex.label, row_number() over (partition by s.split, s.start_w "
    "order by count(*) desc, ex.label) as r from (select split, stage, min(w) as start_w, max(w) as end_w from (select *, w - row_number() over "
    "(partition by split, stage order by w) as g from st) where stage > 0 group by split, stage, g) s join ex on ex.split = s.split and ex.w between s.start_w "
    "and s.end_w and ex.stage > 0 and not ex.attempted group by s.split, s.start_w, s.end_w, s.stage, ex.label) where r = 1"), s="split label", i="start_w end_w stage"))
def stage_spans(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    return targets.stage_spans(state.window_stages(rows, g), targets.window_label_counts(rows, g))


@query("sliding_sequences", table(q("select split, start_w, count(*) as windows, sum(t.stage * (t.w - start_w + 1)) as checksum from (select split, unnest(generate_series(0, n - 32, 16)) "
                                    "as start_w from gr where n >= 32) s join st t using (split) where t.w between start_w and start_w + 31 group by all"),
                                  s="split", i="start_w windows checksum"))
def sliding_sequences(spark, sf):
    s = targets.sliding_sequences(stages(spark, sf), ["stage_BENIGN"], 32, 16)
    return s.select("split", "start_w", F.size("seq").alias("windows"), F.aggregate(
        "seq", F.lit(0).cast("bigint"), lambda acc, x: acc + x["stage"] * (x["w"] - F.col("start_w") + 1)).alias("checksum"))


@query("onset_sequences", table(q("select split, onset_w, off as \"offset\", start_w, count(*) as windows, sum(t.stage * (t.w - start_w + 1)) as checksum from (select *, onset_w - off - 7 as start_w "
                                  "from ons_a cross join (values (1), (3), (6)) v(off)) s join gr using (split) join st t using (split) where start_w >= 0 and start_w + 12 <= n "
                                  "and t.w between start_w and start_w + 11 group by all").replace("off as \"offset\"", "off as lead_offset"),
                                s="split", i="onset_w lead_offset start_w windows checksum"))
def onset_sequences(spark, sf):
    st = stages(spark, sf)
    s = targets.onset_sequences(st, targets.episode_onsets(st), ["stage_BENIGN"], [1, 3, 6], 8, 4)
    return s.select("split", "onset_w", F.col("offset").alias("lead_offset"), "start_w", F.size("seq").alias("windows"), F.aggregate(
        "seq", F.lit(0).cast("bigint"), lambda acc, x: acc + x["stage"] * (x["w"] - F.col("start_w") + 1)).alias("checksum"))


@query("stage_weights", table(q("select stage, windows, raw / avg(raw) over () as weight from (select stage, count(*) as windows, sum(count(*)) over () / count(*) as raw from st group by stage)"),
                              i="stage windows", d="weight"))
def stage_weights(spark, sf):
    return targets.stage_weights(stages(spark, sf))


@query("positive_weights", table(q(" union all ".join(
    f"select '{c}' as target, least((count(*) - greatest(sum({c}), 1)) / greatest(sum({c}), 1), 50) as pos_weight from tgt"
    for c in ("compromise", "attack_now", "escalate_step"))), s="target", d="pos_weight"))
def positive_weights(spark, sf):
    return targets.positive_weights(labelled_states(spark, sf), ["compromise", "attack_now", "escalate_step"]).withColumnRenamed("column", "target")


@query("split_metadata", table(q(
    "select split, any_value(t0_us) as t0_us, any_value(f.c) as flows, count(*) as windows, sum(y_within_K) as positives, avg(y_within_K) as positive_rate, avg(attack_now) as attack_rate, "
    + ", ".join(f"count(*) filter (where stage = {i}) as windows_{n}" for i, n in enumerate(STAGES))
    + ", coalesce(any_value(o.first_onset), -1) as first_onset, coalesce(any_value(o.c), 0) as onsets from tgt join gr using (split) join (select split, count(*) as c from fx group by split) f using (split) "
      "left join (select split, min(onset_w) as first_onset, count(*) as c from ons_c group by split) o using (split) group by split"),
    s="split", i="t0_us flows windows positives first_onset onsets " + " ".join(f"windows_{n}" for n in STAGES), d="positive_rate attack_rate"))
def split_metadata(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    states = targets.with_targets(g.with_window_start(state.window_stages(rows, g)))
    m = targets.split_metadata(states, rows)
    return m.withColumns({"first_onset": F.coalesce(F.get("onsets", F.lit(0)), F.lit(-1)), "onsets": F.size("onsets")}).withColumnRenamed("t0", "t0_us")
