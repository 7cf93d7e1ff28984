"""Queries for packets, flow assembly and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import INTERNAL, comparable, cte, flows, q, table
from tidewatch import Grid, WindowSpec, fixtures
from tidewatch.operators import flows as assembly
from tidewatch.operators import packets as pk
from tidewatch.operators import state
from tidewatch.schema import PACKET_STAT_COLUMNS, PCAP_FEATURES
from tidewatch.session import cut_lineage, prepare
from tidewatch.sources import flowlogs, tables

QUERIES, ORACLES = {}, {}
MINUTE = WindowSpec(60, 30)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


cte("pk", "select " + ", ".join(f"{text} as {name}" for name, text in fixtures.PACKET_SQL.items()) + " from lineitem")
cte("pdata", "select *, seq + payload_len as seq_end from pk where protocol = 6 and payload_len > 0")
cte("pret", "select frame_no, case when seq_end <= max(seq_end) over (partition by split, src_ip, dst_ip, src_port, dst_port order by frame_no rows between "
            "unbounded preceding and 1 preceding) then 1 else 0 end as retrans from pdata")
cte("pgr", "select split, min(at_us) // 60000000 * 60000000 as t0, (max(at_us) - min(at_us) // 60000000 * 60000000) // 30000000 + 1 as n from pk group by split")
cte("psp", "select split, unnest(generate_series(0, n - 1)) as w from pgr")
cte("pgap", "select pk.*, coalesce(retrans, 0) as retrans, pk.at_us - pgr.t0 as off, (pk.at_us - lag(pk.at_us) over (partition by split order by pk.at_us)) / 1e6 as gap "
            "from pk join pgr using (split) left join pret using (frame_no)")
cte("pex", "select *, unnest(generate_series(greatest(0, off // 30000000 - 1), off // 30000000)) as w from pgap")
_W = "protocol = 6 and tcp_flags & 4 = 0"
_PB = "(case when payload_len >= 0.5 then 1 else 0 end + case when payload_len >= 64.5 then 1 else 0 end + case when payload_len >= 512.5 then 1 else 0 end + case when payload_len >= 1024.5 then 1 else 0 end)"
_PF = {
    "pcap_pkts": "count(*)", "pcap_ttl_mean": "avg(ttl)", "pcap_ttl_std": "stddev_pop(ttl)", "pcap_ttl_distinct": "count(distinct ttl)",
    "pcap_ttl_low_rate": "avg(case when ttl < 60 then 1.0 else 0 end)", "pcap_frag_rate": "avg(case when more_frags or frag_off > 0 then 1.0 else 0 end)",
    "pcap_retrans_rate": "sum(retrans) / count(*) filter (where protocol = 6 and payload_len > 0)",
    "pcap_zero_win_rate": f"count(*) filter (where {_W} and tcp_win = 0) / count(*) filter (where protocol = 6)",
    "pcap_win_std": f"stddev_pop(tcp_win) filter (where {_W})",
    **{f"pcap_{n}": f"avg(case when {_PB} = {b} then 1.0 else 0 end)" for b, n in enumerate(
        ("payload_0_rate", "payload_1_64_rate", "payload_65_512_rate", "payload_513_1024_rate", "payload_gt1024_rate"))},
    "pcap_iat_std": "case when count(gap) > 1 then stddev_pop(gap) end",
    "pcap_iat_cv": "case when count(gap) > 1 and sum(gap) > 0 then stddev_pop(gap) / avg(gap) end",
    "pcap_syn_only_rate": "count(*) filter (where protocol = 6 and tcp_flags & 2 > 0 and tcp_flags & 16 = 0) / count(*) filter (where protocol = 6)",
    "pcap_rst_rate": "count(*) filter (where protocol = 6 and tcp_flags & 4 > 0) / count(*) filter (where protocol = 6)",
}
cte("pvec", "select split, w, " + ", ".join(f"{v} as {c}" for c, v in _PF.items()) + " from pex group by split, w")


def packets(spark, sf):
    """The fixture's packets, written once: numbering them takes a sort, and operators read packets more than once."""
    prepare(spark)
    return cut_lineage(fixtures.packets(spark, sf))


@query("packet_windows", table(q("select psp.split, psp.w, " + ", ".join(
    f"coalesce(case when isnan(cast({c} as double)) then 0 else {c} end, 0) as {c}" for c in PCAP_FEATURES) + " from psp left join pvec using (split, w)"),
    s="split", i="w", d=" ".join(PCAP_FEATURES)))
def packet_windows(spark, sf):
    rows = packets(spark, sf)
    return pk.packet_window_features(pk.with_retransmissions(rows), Grid.fit(rows, MINUTE))


@query("retransmissions", table(q("select split, src_ip, count(*) as segments, sum(retrans) as retrans from pdata join pret using (frame_no) group by split, src_ip"),
                                s="split src_ip", i="segments retrans"))
def retransmissions(spark, sf):
    rows = pk.with_retransmissions(packets(spark, sf)).where("protocol = 6 and payload_len > 0")
    return rows.groupBy("split", "src_ip").agg(F.count("*").alias("segments"), F.sum("retrans").alias("retrans"))


cte("pdup", "select *, frame_no // (32768 * 1024) as fno, concat(ttl, '|', dst_port % 10, '|', tcp_win) as digest from pk")
# the last 64 packets kept, carried along each capture
cte("pdup1", "select split, digest, at_us, row_number() over (partition by split order by fno, at_us) as k from pdup")
_KEPT = """with recursive {head} walk(split, k, recent, again, at_us) as (
  select distinct split, cast(0 as bigint), cast([] as varchar[]), false, cast(null as bigint) from pdup1
  union all select o.split, o.k, case when list_contains(recent, digest) then recent else list_append(recent[-63:], digest) end,
    list_contains(recent, digest), o.at_us from walk w join pdup1 o on o.split = w.split and o.k = w.k + 1)
"""


def _kept(sql: str) -> str:
    head = q("select 1 from pdup1").removeprefix("with ").removesuffix(" select 1 from pdup1")
    return _KEPT.format(head=head + ",") + sql


@query("capture_manifest", table(_kept(
    "select split, concat(split, '.pcap') as capture, count(*) filter (where not again) as packets, 0 as frames_skipped, count(*) filter (where again) as duplicates_dropped, "
    "min(at_us) filter (where not again) as first_packet, max(at_us) filter (where not again) as last_packet from walk where k > 0 group by split"), s="split capture", i="packets frames_skipped duplicates_dropped first_packet last_packet"))
def capture_manifest(spark, sf):
    """S7 + S15: near-identical frames dropped, then counted per capture."""
    rows = packets(spark, sf).withColumns({
        "frame_no": F.expr("frame_no div (32768 * 1024)"), "ip_digest": F.concat_ws("|", "ttl", F.col("dst_port") % 10, "tcp_win"), "skipped": F.lit(False)})
    return pk.capture_manifest(rows, pk.drop_capture_duplicates(rows))


cte("fp0", "select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as from_a, case when protocol = 6 then tcp_flags else 0 end as fl from pk where protocol in (6, 17)")
cte("fp1", "select *, case when from_a then src_ip else dst_ip end as ip_a, case when from_a then src_port else dst_port end as port_a, "
           "case when from_a then dst_ip else src_ip end as ip_b, case when from_a then dst_port else src_port end as port_b from fp0")
cte("fp", "select *, dense_rank() over (order by split, protocol, ip_a, port_a, ip_b, port_b) as tup, "
          "row_number() over (partition by split, protocol, ip_a, port_a, ip_b, port_b order by frame_no) as rn from fp1")
_NEW = "(p.at_us - f.first_us > 120000000 or (p.fl & 2 > 0 and p.fl & 16 = 0 and (f.rst or (f.fa and f.fb))))"
_FOLD = ("with recursive {head}, fold as (select tup, rn, at_us as first_us, from_a and fl & 1 > 0 as fa, not from_a and fl & 1 > 0 as fb, fl & 4 > 0 as rst, 0 as flow_no, "
         "from_a as dir from fp where rn = 1 union all select p.tup, p.rn, case when " + _NEW + " then p.at_us else f.first_us end, "
         "(case when " + _NEW + " then false else f.fa end) or (p.from_a and p.fl & 1 > 0), (case when " + _NEW + " then false else f.fb end) or (not p.from_a and p.fl & 1 > 0), "
         "(case when " + _NEW + " then false else f.rst end) or p.fl & 4 > 0, f.flow_no + case when " + _NEW + " then 1 else 0 end, "
         "case when " + _NEW + " and p.fl & 2 > 0 and p.fl & 16 = 0 then p.from_a else f.dir end from fold f join fp p on p.tup = f.tup and p.rn = f.rn + 1) ")


def _recursive(body: str) -> str:
    plain = q("select * from fp")
    head = plain[len("with "):plain.rindex(" select * from fp")]
    return _FOLD.replace("{head}", head) + body


_FLOWCOLS = {
    "duration_us": "arg_max(at_us, rn) - arg_min(at_us, rn)", "fwd_pkts": "count(*) filter (where fwd)", "bwd_pkts": "count(*) filter (where not fwd)",
    "fwd_bytes": "coalesce(sum(payload_len) filter (where fwd), 0)", "bwd_bytes": "coalesce(sum(payload_len) filter (where not fwd), 0)",
    "flow_iat_mean": "coalesce(avg(gap), 0)", "flow_iat_std": "coalesce(stddev_samp(gap), 0)", "flow_iat_max": "coalesce(max(gap), 0)", "flow_iat_min": "coalesce(min(gap), 0)",
    "fin_cnt": "count(*) filter (where fl & 1 > 0)", "syn_cnt": "count(*) filter (where fl & 2 > 0)", "rst_cnt": "count(*) filter (where fl & 4 > 0)",
    "ack_cnt": "count(*) filter (where fl & 16 > 0)", "pkt_len_min": "min(payload_len)", "pkt_len_max": "max(payload_len)", "pkt_len_mean": "avg(payload_len)",
    "pkt_len_std": "coalesce(stddev_samp(payload_len), 0)", "down_up_ratio": "case when count(*) filter (where fwd) > 0 then count(*) filter (where not fwd) / count(*) filter (where fwd) else 0 end",
    "fwd_init_win": "coalesce(arg_min(tcp_win, rn) filter (where fwd and protocol = 6), 0)", "bwd_init_win": "coalesce(arg_max(tcp_win, rn) filter (where not fwd and protocol = 6), 0)",
    "fwd_seg_size_min": "coalesce(min(hdr_len) filter (where fwd), 0)", "active_mean": "coalesce(avg(active), 0)", "idle_mean": "coalesce(avg(idle), 0)",
    "fwd_pkt_len_std": "coalesce(stddev_samp(payload_len) filter (where fwd), 0)", "bwd_pkt_len_std": "coalesce(stddev_samp(payload_len) filter (where not fwd), 0)",
    "fwd_iat_std": "coalesce(stddev_samp(dgap) filter (where fwd), 0)", "bwd_iat_std": "coalesce(stddev_samp(dgap) filter (where not fwd), 0)",
    "fwd_rst_cnt": "count(*) filter (where fwd and fl & 4 > 0)", "bwd_rst_cnt": "count(*) filter (where not fwd and fl & 4 > 0)",
    "fwd_hdr_bytes": "coalesce(sum(hdr_len) filter (where fwd), 0)",
    "fwd_data_pkts": "count(*) filter (where fwd and payload_len > 0) - coalesce(arg_min(case when payload_len > 0 then 1 else 0 end, rn) filter (where fwd), 0)",
}
_INTS = ("protocol src_port dst_port fwd_pkts bwd_pkts fwd_bytes bwd_bytes fin_cnt syn_cnt rst_cnt ack_cnt fwd_init_win bwd_init_win fwd_seg_size_min "
         "fwd_rst_cnt bwd_rst_cnt fwd_hdr_bytes fwd_data_pkts")
_DBL = [c for c in _FLOWCOLS if c not in _INTS.split()]
_FLOWSQL = _recursive(
    ", j as (select fp.*, flow_no, dir = from_a as fwd, at_us - lag(at_us) over (partition by fp.tup, flow_no order by fp.rn) as sgap, "
    "abs(at_us - lag(at_us) over (partition by fp.tup, flow_no, from_a order by fp.rn)) as dgap, dir from fp join fold on fold.tup = fp.tup and fold.rn = fp.rn), "
    "k as (select *, abs(sgap) as gap, case when sgap > 5000000 then sgap end as idle, sum(case when sgap > 5000000 then 1 else 0 end) over (partition by tup, flow_no order by rn) as seg from j), "
    "seg as (select tup, flow_no, seg, arg_max(at_us, rn) - arg_min(at_us, rn) as len, max(seg) over (partition by tup, flow_no) as last_seg from k group by tup, flow_no, seg), "
    "m as (select k.*, case when k.rn = min(k.rn) over (partition by k.tup, k.flow_no, k.seg) and seg.seg < seg.last_seg and seg.len > 0 then seg.len end as active "
    "from k join seg on seg.tup = k.tup and seg.flow_no = k.flow_no and seg.seg = k.seg), "
    "result as (select any_value(split) as split, arg_min(at_us, rn) as ts, any_value(case when dir then ip_a else ip_b end) as src_ip, any_value(case when dir then port_a else port_b end) as src_port, "
    "any_value(case when dir then ip_b else ip_a end) as dst_ip, any_value(case when dir then port_b else port_a end) as dst_port, any_value(protocol) as protocol, "
    + ", ".join(f"{v} as {c}" for c, v in _FLOWCOLS.items()) + " from m group by tup, flow_no having count(*) >= 2) "
    + table("select * from result", s="split src_ip dst_ip", i="ts " + _INTS, d=" ".join(_DBL)))


@query("assemble_flows", _FLOWSQL)
def assemble_flows(spark, sf):
    return assembly.assemble_flows(packets(spark, sf)).select("split", "ts", "src_ip", "dst_ip", *_INTS.split(), *_DBL)


#: the same flows by their unordered ends, as they are reported live
LIVE_FLOW_SQL = _recursive(
    ", j as (select fp.*, flow_no, dir from fp join fold on fold.tup = fp.tup and fold.rn = fp.rn), "
    "result as (select any_value(split) as split, any_value(protocol) as protocol, any_value(ip_a) as ip_a, any_value(port_a) as port_a, any_value(ip_b) as ip_b, any_value(port_b) as port_b, "
    "arg_min(at_us, rn) as first_ts, arg_max(at_us, rn) as last_ts, any_value(dir) as from_a, count(*) as pkts, count(*) filter (where from_a) as a_pkts, count(*) filter (where not from_a) as b_pkts, "
    "coalesce(sum(payload_len) filter (where from_a), 0) as a_bytes, coalesce(sum(payload_len) filter (where not from_a), 0) as b_bytes from j group by tup, flow_no having count(*) >= 2) "
    + table("select * from result", s="split ip_a ip_b", i="protocol port_a port_b first_ts last_ts from_a pkts a_pkts b_pkts a_bytes b_bytes"))

_SES = "split, src_ip, dst_ip, src_port, dst_port, protocol"


@query("session_packet_stats", table(q(
    f"select {_SES}, count(*) as packet_count, avg(ttl) as ttl_mean, var_pop(ttl) as ttl_variance, coalesce(avg(case when protocol = 6 then tcp_win end), 0) as tcp_win_mean, "
    "coalesce(max(case when protocol = 6 then tcp_win end), 0) as tcp_win_max, count(*) filter (where more_frags or frag_off > 0) as ip_frag_count, count(*) filter (where protocol = 6 and seq = prev) as retrans_count, "
    "count(*) filter (where payload_len <= 64) as payload_0_64, count(*) filter (where payload_len between 65 and 128) as payload_65_128, count(*) filter (where payload_len between 129 and 512) as payload_129_512, "
    "count(*) filter (where payload_len between 513 and 1024) as payload_513_1024, count(*) filter (where payload_len > 1024) as payload_gt_1024 "
    f"from (select *, lag(seq) over (partition by {_SES} order by frame_no) as prev from pk where protocol in (6, 17)) group by {_SES}"),
    s="split src_ip dst_ip", i="src_port dst_port protocol packet_count ip_frag_count retrans_count payload_0_64 payload_65_128 payload_129_512 payload_513_1024 payload_gt_1024",
    d="ttl_mean ttl_variance tcp_win_mean tcp_win_max"))
def session_packet_stats(spark, sf):
    return assembly.session_packet_stats(packets(spark, sf))


@query("port_scan_signatures")
def port_scan_signatures(spark, sf):
    return assembly.port_scan_signatures(packets(spark, sf))


cte("lastp", "select * from (select *, row_number() over (partition by split, src_ip order by frame_no desc) as b from pk where protocol in (6, 17)) where b <= 100")
cte("mv", "select *, coalesce(dst_port <> lag(dst_port) over (partition by split, src_ip order by b desc), true) as moved from lastp")
ORACLES["port_scan_signatures"] = table(q(
    "select split, src_ip, case when seen < 15 or moves < 5 then 'benign' when ratio > 0.6 then 'sequential_scan' when ratio < 0.1 and ports > 10 then 'randomised_scan' else 'benign' end as signature from "
    "(select split, src_ip, count(*) as seen, count(distinct dst_port) as ports, count(*) filter (where moved) as moves from mv group by split, src_ip) join "
    "(select split, src_ip, count(*) filter (where abs(d) = 1) / nullif(count(d), 0) as ratio from (select *, dst_port - lag(dst_port) over (partition by split, src_ip order by b desc) as d from mv where moved) group by split, src_ip) using (split, src_ip)"),
    s="split src_ip signature")


@query("packet_flow_merge", table(q(
    "select psp.split, psp.w, coalesce(pcap_pkts, 0) as pcap_pkts, 1 as has_pcap, 0 as masked_pkts, 0 as masked_flag from psp left join pvec using (split, w)"),
    s="split", i="w", d="pcap_pkts has_pcap masked_pkts masked_flag"))
def packet_flow_merge(spark, sf):
    rows = packets(spark, sf)
    g = Grid.fit(rows, MINUTE)
    joined = pk.with_packets(g.spine().drop("ts"), pk.packet_window_features(rows, g))
    masked = pk.mask_packets(joined).select("split", "w", F.col("pcap_pkts").alias("masked_pkts"), F.col("has_pcap").alias("masked_flag"))
    return joined.select("split", "w", "pcap_pkts", "has_pcap").join(masked, ["split", "w"])


@query("packet_flow_alignment", table(q(
    "select split, corr(a, b) as corr_log_packets, sum(p) / greatest(sum(c), 1) as packet_ratio from (select psp.split, psp.w, coalesce(pcap_pkts, 0) as p, coalesce(c, 0) as c, case when coalesce(c, 0) > 0 then ln(1 + coalesce(pcap_pkts, 0)) end as a, "
    "case when coalesce(c, 0) > 0 then ln(1 + coalesce(c, 0)) end as b from psp left join pvec using (split, w) left join (select split, w, count(*) as c from pex where protocol = 6 group by split, w) using (split, w)) group by split"),
    s="split", d="corr_log_packets packet_ratio"))
def packet_flow_alignment(spark, sf):
    rows = packets(spark, sf)
    g = Grid.fit(rows, MINUTE)
    tcp = g.to_windows(g.locate(rows.where("protocol = 6").select("split", "ts")).groupBy("split", "slice_no", "n").agg(F.count("*").alias("c")))
    tcp = tcp.groupBy("split", "w").agg(F.sum("c").alias("pkts_total"))
    joined = pk.packet_window_features(rows, g).join(tcp, ["split", "w"], "left").fillna(0, ["pkts_total"])
    return pk.packet_flow_alignment(joined).select("split", "corr_log_packets", "packet_ratio")


# ---- sources over text columns derived from the tables ---------------------------------------------------

_BACK = {v: k for k, v in {**flowlogs.HEADER, **flowlogs.PACKET_STAT_HEADER}.items()}


def _raw_log(spark, sf):
    """Every fixture flow as the text columns of a flow-meter log (header padding included)."""
    rows = flows(spark, sf)
    names = [c for c in rows.columns if c in _BACK]
    early = F.col("flow_id") % 50 == 0
    when = F.when(F.col("flow_id") % 97 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    text = {c: F.col(c).cast("string") for c in names} | {"ts": when}
    return rows.select("split", "flow_id", *((text[c]).alias(f" {_BACK[c]} ") for c in names)), early


@query("flow_log_source", table(q("select split, src_ip, epoch_us(ts) as ts, src_port, dst_port, fwd_bytes, duration_us, case label when 'Infiltration - Portscan' then stage else stage end as stage, attempted "
                                  "from fx where flow_id % 97 <> 0"), s="split src_ip", i="ts src_port dst_port fwd_bytes stage attempted", d="duration_us"))
def flow_log_source(spark, sf):
    """Text columns to canonical flows; rows without a readable time are dropped."""
    raw, _ = _raw_log(spark, sf)
    out = flowlogs.canonical_flow_log(raw.drop("flow_id"), F.col("split"), INTERNAL)
    return out.select("split", "src_ip", "ts", "src_port", "dst_port", "fwd_bytes", "stage", "attempted", "duration_us")


@query("quarantined_log", table(q("select split, case when flow_id % 97 <> 0 and ts < timestamp '2024-01-10 00:00:00' then 'before_capture_date' when flow_id % 31 = 0 then 'label_-1' else 'kept' end as reason, count(*) as flows from fx group by all"),
                                s="split reason", i="flows"))
def quarantined_log(spark, sf):
    """Rows of a day file set aside, with a reason, and counted."""
    raw, _ = _raw_log(spark, sf)
    raw = raw.withColumn(" Label ", F.when(F.col("flow_id") % 31 == 0, F.lit("-1")).otherwise(F.col("` Label `")))
    marked = flowlogs.quarantine(raw, F.lit("2024-01-10").cast("date"))
    return marked.groupBy("split", F.coalesce("_reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("flows"))


@query("time_slice_report", table(q("select split, label, count(*) filter (where ts >= timestamp '2024-01-05 06:00:00' and ts < timestamp '2024-01-19 12:00:00') as kept, count(*) as total from fx group by split, label"),
                                  s="split label", i="kept total"))
def time_slice_report(spark, sf):
    return flowlogs.slice_report(flows(spark, sf), F.lit("2024-01-05 06:00:00").cast("timestamp"), F.lit("2024-01-19 12:00:00").cast("timestamp"))


@query("score_store", table(q("select concat('run-', split) as run, split, w, channel, case channel when 'comp' then ports / 40.0 else n_flows / 400.0 end as score from "
                              "(select sp.split, sp.w, coalesce(ports, 0) as ports, coalesce(n_flows, 0) as n_flows from sp left join cnt using (split, w)) cross join (values ('comp'), ('threat')) c(channel)"),
                            s="run split channel", i="w", d="score"))
def score_store(spark, sf):
    """One nested JSON text per run, parsed and exploded to rows."""
    rows = flows(spark, sf)
    g = Grid.fit(rows, WindowSpec(3600, 1800))
    spread = state.spread_features(rows, g).select("split", "w", (F.col("uniq_dst_port") / 40.0).alias("comp"))
    n = g.to_windows(g.locate(rows.select("split", "ts")).groupBy("split", "slice_no", "n").agg(F.count("*").alias("c"))).groupBy("split", "w").agg(
        (F.sum("c") / 400.0).alias("threat"))
    dense = g.fill(spread.join(n, ["split", "w"]), ["comp", "threat"], keep_ts=False)
    arrays = dense.groupBy("split").agg(F.sort_array(F.collect_list(F.struct("w", "comp", "threat"))).alias("a"))
    text = F.to_json(F.struct(F.struct(F.create_map(F.col("split"), F.struct(
        F.transform("a", lambda x: x["comp"]).alias("scores"), F.transform("a", lambda x: x["threat"]).alias("threat_scores"))).alias("per_day")).alias("metrics")))
    docs = arrays.select(F.concat(F.lit("run-"), "split").alias("_run"), F.from_json(text, tables.SCORE_SCHEMA).alias("d")).select("_run", "d.metrics")
    return tables.explode_scores(docs, F.col("_run"), F.lit(1)).drop("seed")
