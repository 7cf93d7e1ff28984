"""Queries for audits and for pairing and comparing sources, builds and score series."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import INTERNAL, comparable, cte, flows, grid_of, q, table
from suite.detection import alarmed, scored
from tidewatch.operators import alerts, blocks, recon, state
from tidewatch.schema import STAGES

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("label_audit", table(q("select split, label, count(*) as flows, 100.0 * count(*) / sum(count(*)) over (partition by split) as share_pct, case label when 'Infiltration - Portscan' then 3 else any_value(stage) end as stage, "
                              "case label when 'BENIGN' then '' when 'Portscan' then 'T1595.001' when 'FTP-Patator - Attempted' then 'T1110.001' when 'Infiltration - Portscan' then 'T1046' when 'Botnet' then 'T1071.001' else 'T1498' end as technique, "
                              "any_value(attempted) as attempted from fx group by split, label"), s="split label technique", i="flows stage attempted", d="share_pct"))
def label_audit(spark, sf):
    return recon.label_audit(flows(spark, sf))


_SCHED = [("week0", "Portscan", "2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("week1", "DDoS", "2024-01-09 00:00:00", "2024-01-10 00:00:00"), ("week9", "Botnet", "2024-02-09 00:00:00", "2024-02-10 00:00:00")]


@query("schedule_timing", table(q(
    "select coalesce(a.split, b.split) as split, coalesce(a.label, b.label) as label, first_seen, last_seen, flows, epoch_us(cast(s as timestamp)) as planned_start, epoch_us(cast(e as timestamp)) as planned_end from (select split, label, epoch_us(min(ts)) as first_seen, epoch_us(max(ts)) as last_seen, count(*) as flows "
    "from fx where stage > 0 group by split, label) a full outer join (values " + ", ".join(str(r) for r in _SCHED) + ") b(split, label, s, e) on a.split = b.split and a.label = b.label"),
    s="split label", i="first_seen last_seen flows planned_start planned_end"))
def schedule_timing(spark, sf):
    plan = spark.createDataFrame(_SCHED, "split string, label string, planned_start string, planned_end string")
    plan = plan.withColumns({c: F.col(c).cast("timestamp") for c in ("planned_start", "planned_end")})
    return recon.schedule_timing(flows(spark, sf), plan)


@query("minute_stages", table(q("select split, epoch_us(date_trunc('minute', ts)) as \"minute\", " + ", ".join(f"count(*) filter (where stage = {i}) as {n}" for i, n in enumerate(STAGES)) + " from fx group by 1, 2").replace('as "minute"', "as at_minute"),
                              s="split", i="at_minute " + " ".join(STAGES)))
def minute_stages(spark, sf):
    return recon.minute_stages(flows(spark, sf)).withColumnRenamed("minute", "at_minute")


@query("dominant_and_present", table(q(
    "select split, g.stage, sum(case when st.stage = g.stage then 1 else 0 end) as dominant, sum(case g.stage when 0 then (case when s1+s2+s3+s4+s5+s6 = 0 then 1 else 0 end) when 1 then s1 when 2 then s2 when 3 then s3 when 4 then s4 when 5 then s5 else s6 end) as present "
    "from st cross join (select unnest(generate_series(0, 6)) as stage) g group by split, g.stage"), s="split", i="stage dominant present"))
def dominant_and_present(spark, sf):
    rows = flows(spark, sf)
    return recon.dominant_and_present(rows, grid_of(rows))


@query("file_profile", table(q("select split, label, attempted, count(*) as flows, epoch_us(min(ts)) as first_ts, epoch_us(max(ts)) as last_ts from fx group by split, label, attempted"), s="split label", i="attempted flows first_ts last_ts"))
def file_profile(spark, sf):
    return recon.file_profile(flows(spark, sf))


@query("attack_endpoints", table(q(
    "select * from (select split, label, kind, value, count(*) as flows, row_number() over (partition by split, label, kind order by count(*) desc, value) as rank from (select split, label, 'src_ip' as kind, src_ip as value from fx where stage > 0 "
    "union all select split, label, 'dst_ip', dst_ip from fx where stage > 0 union all select split, label, 'dst_port', cast(dst_port as varchar) from fx where stage > 0) group by split, label, kind, value) where rank <= 5"),
    s="split label kind value", i="flows rank"))
def attack_endpoints(spark, sf):
    return recon.attack_endpoints(flows(spark, sf))


# ---- pairing: the flows against themselves, some removed, some shifted by 3 ms ----------------------------

cte("ra", "select *, flow_id as a_id from fx")
cte("rb", "select * exclude (ts, bwd_bytes), flow_id as b_id, case when flow_id % 5 = 0 then ts + interval 3 milliseconds else ts end as ts, case when flow_id % 7 = 0 then bwd_bytes + 1 when flow_id % 11 = 0 then 0 else bwd_bytes end as bwd_bytes from fx where flow_id % 17 <> 0")
_K = "split, src_ip, dst_ip, src_port, dst_port, protocol"
cte("pxe", f"select a_id, b_id, 'exact' as match from (select *, row_number() over (partition by {_K}, ts order by a_id) as i from ra) x join (select *, row_number() over (partition by {_K}, ts order by b_id) as i from rb) y using ({_K}, ts, i)")
cte("pxn", f"select min_by(a_id, us) as a_id, b_id from (select x.a_id, epoch_us(x.ts) as us, y.b_id, row_number() over (partition by x.a_id order by abs(epoch_us(x.ts) - epoch_us(y.ts)), y.ts, y.b_id) as r from ra x join rb y using ({_K}) "
           "where abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 5000 and x.a_id not in (select a_id from pxe) and y.b_id not in (select b_id from pxe)) where r = 1 group by b_id")
cte("pairs", "select a_id, b_id, match from pxe union all select a_id, b_id, 'near' from pxn")


def _sides(spark, sf):
    rows = flows(spark, sf)
    moved = F.when(F.col("flow_id") % 5 == 0, F.col("ts") + F.expr("interval 3 milliseconds")).otherwise(F.col("ts"))
    other = rows.where("flow_id % 17 <> 0").withColumns({"ts": moved, "bwd_bytes": F.when(F.col("flow_id") % 7 == 0, F.col("bwd_bytes") + 1).when(F.col("flow_id") % 11 == 0, 0).otherwise(F.col("bwd_bytes"))})
    return rows, other, recon.pair_flows(rows, other, 5000, "flow_id", "flow_id")


@query("pair_flows", table(q("select * from pairs"), s="match", i="a_id b_id"))
def pair_flows(spark, sf):
    return _sides(spark, sf)[2]


_C = ("bwd_bytes", "fwd_bytes", "duration_us")


def _agree(c):
    tol = "2.0" if c == "duration_us" else "1e-6"
    return (f"select '{c}' as \"column\", count(*) as pairs, avg(case when eq then 1.0 else 0 end) as equal, avg(case when abs(x - y) <= greatest({tol}, 0.01 * abs(y)) then 1.0 else 0 end) as within_1pct, "
            "count(*) filter (where not eq and x = 0 and y <> 0) as left_zero, count(*) filter (where not eq and x <> 0 and y = 0) as right_zero, avg(x) as mean_left, avg(y) as mean_right, median(x / nullif(y, 0)) filter (where not eq and y <> 0) as median_ratio "
            f"from (select cast(ra.{c} as double) as x, cast(rb.{c} as double) as y, abs(ra.{c} - rb.{c}) <= greatest({tol}, 1e-9 * abs(rb.{c})) as eq from pairs join ra using (a_id) join rb using (b_id))")


@query("compare_columns", table(q(" union all ".join(_agree(c) for c in _C)).replace('"column"', "metric"), s="metric", i="pairs left_zero right_zero", d="equal within_1pct mean_left mean_right median_ratio"))
def compare_columns(spark, sf):
    a, b, pairs = _sides(spark, sf)
    return recon.compare_columns(pairs, a, b, "flow_id", "flow_id", list(_C)).withColumnRenamed("column", "metric")


@query("explain_unmatched", table(q(
    f"select split, protocol, least(fwd_pkts + bwd_pkts, 10) as pkts, count(*) as flows, count(*) filter (where rev) as reversed_tuple, count(*) filter (where same) as same_tuple from (select u.*, exists (select 1 from rb where rb.split = u.split and rb.src_ip = u.src_ip and rb.dst_ip = u.dst_ip and "
    "rb.src_port = u.src_port and rb.dst_port = u.dst_port and rb.protocol = u.protocol) as same, exists (select 1 from rb where rb.split = u.split and rb.src_ip = u.dst_ip and rb.dst_ip = u.src_ip and rb.src_port = u.dst_port and rb.dst_port = u.src_port and rb.protocol = u.protocol) as rev "
    "from ra u where a_id not in (select a_id from pairs)) group by 1, 2, 3"), s="split", i="protocol pkts flows reversed_tuple same_tuple"))
def explain_unmatched(spark, sf):
    a, b, pairs = _sides(spark, sf)
    left = recon.unmatched(a, pairs, "flow_id", "a_id")
    return recon.unmatched_summary(recon.explain_unmatched(left, b))


# ---- builds and series -----------------------------------------------------------------------------------

_P = ("score", "score2")


@query("matrix_parity", table(q(" union all ".join(
    f"select '{f}' as feature, count(*) as windows, count(*) filter (where rel > 1e-6) as mismatches, max(rel) as worst, avg(x) as mean_a, avg(y) as mean_b, corr(x, y) as corr from (select {f} as x, {f} + case when w % 9 = 0 then 0.01 else 0 end as y, "
    f"abs({f} - ({f} + case when w % 9 = 0 then 0.01 else 0 end)) / greatest(abs({f}), abs({f} + case when w % 9 = 0 then 0.01 else 0 end), 1) as rel from sc join wn using (split) where w >= 4 and w < n - 4)" for f in _P)),
    s="feature", i="windows mismatches", d="worst mean_a mean_b corr"))
def matrix_parity(spark, sf):
    s = scored(spark, sf)
    bump = F.when(F.col("w") % 9 == 0, F.lit(0.01)).otherwise(F.lit(0.0))
    sizes = s.groupBy("split").agg(F.count("*").alias("n"))
    return recon.matrix_parity(s, s.withColumns({c: F.col(c) + bump for c in _P}), list(_P), 1e-6, recon.EDGE_WINDOWS, sizes)


@query("build_equality", table(q("select split, count(*) as rows_a, count(*) filter (where w % 40 <> 3) as rows_b, count(*) filter (where w % 40 = 3) + count(*) filter (where w % 50 = 7 and w % 40 <> 3) as only_a, count(*) filter (where w % 50 = 7 and w % 40 <> 3) as only_b, "
                                 "count(*) filter (where w % 40 = 3 or w % 50 = 7) = 0 as equal from st group by split"), s="split", i="rows_a rows_b only_a only_b equal"))
def build_equality(spark, sf):
    rows = flows(spark, sf)
    s = state.window_stages(rows, grid_of(rows)).select("split", "w", "stage")
    other = s.where("w % 40 <> 3").withColumn("stage", F.when(F.col("w") % 50 == 7, F.col("stage") + 10).otherwise(F.col("stage")))
    return recon.build_equality(s, other)


@query("series_alignment", table(q("select split, count(*) as windows, corr(score, score2) as corr, count(*) filter (where alarm) as alarms_a, count(*) filter (where score2 > 0.2) as alarms_b, count(*) filter (where alarm and score2 > 0.2) as alarms_both from al group by split"),
                                 s="split", i="windows alarms_a alarms_b alarms_both", d="corr"))
def series_alignment(spark, sf):
    a = alarmed(spark, sf)
    b = a.select("split", "ts", F.col("score2").alias("score"), (F.col("score2") > 0.2).alias("alarm"))
    return recon.series_alignment(a, b)


@query("correlation_matrix", table(q("select 'score' as a, 'score' as b, corr(score, score) as corr from sc union all select 'score', 'score2', corr(score, score2) from sc union all select 'score2', 'score2', corr(score2, score2) from sc"), s="a b", d="corr"))
def correlation_matrix(spark, sf):
    tall = scored(spark, sf).unpivot(["split", "w"], list(_P), "series", "score")
    return recon.correlation_matrix(tall, list(_P))


@query("prefix_invariance", table(q("select split, count(*) filter (where 2 * w < n) as windows, 0.0 as threshold, 0.0 as alarm from sc join gr using (split) group by split"), s="split", i="windows", d="threshold alarm"))
def prefix_invariance(spark, sf):
    """Thresholds of each split's first half equal those of the whole there (differences must be 0)."""
    s = scored(spark, sf)
    sizes = s.groupBy("split").agg(F.count("*").alias("n"))
    half = s.join(sizes, "split").where("2 * w < n").drop("n")
    whole = alerts.causal_threshold(s, 0.9).withColumn("alarm", F.col("alarm").cast("int"))
    prefix = alerts.causal_threshold(half, 0.9).withColumn("alarm", F.col("alarm").cast("int"))
    return recon.prefix_difference(whole, prefix, ["threshold", "alarm"])


@query("clip_rates", table(q("select split, 'score' as metric, avg(case when abs(score) >= 0.2 then 1.0 else 0 end) as overall, avg(case when abs(score) >= 0.2 then 1.0 else 0 end) filter (where attack_now = 1) as attack, avg(case when abs(score) >= 0.2 then 1.0 else 0 end) filter (where attack_now = 0) as benign from sc group by split"),
                           s="split metric", d="overall attack benign"))
def clip_rates(spark, sf):
    return recon.clip_rates(scored(spark, sf), ["score"], 0.2).withColumnRenamed("column", "metric")


@query("set_operations", table(q("select 'both' as kind, src_ip as ip from (select src_ip from fx intersect select dst_ip from fx) union all select 'source_only', src_ip from (select src_ip from fx except select dst_ip from fx) union all select 'any', src_ip from (select src_ip from fx union select dst_ip from fx)"), s="kind ip"))
def set_operations(spark, sf):
    """R13 + R14: intersection, difference, distinct union of address sets."""
    rows = flows(spark, sf)
    a, b = rows.select(F.col("src_ip").alias("ip")).distinct(), rows.select(F.col("dst_ip").alias("ip")).distinct()
    parts = {"both": a.intersect(b), "source_only": a.subtract(b), "any": a.unionByName(b).dropDuplicates()}
    out = None
    for kind, part in parts.items():
        one = part.select(F.lit(kind).alias("kind"), "ip")
        out = one if out is None else out.unionByName(one)
    return out
