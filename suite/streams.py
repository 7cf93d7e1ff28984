"""Queries that replay the tables as streams (or stream what a batch derived from them) and read the sink back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite.base import INTERNAL, comparable, cte, q, table
from suite.capture import LIVE_FLOW_SQL
from suite.detection import alarmed, scored
from tidewatch import WindowSpec, fixtures
from tidewatch.functions.labels import with_stages
from tidewatch.session import prepare
from tidewatch.streaming import live, stateful
from tidewatch.streaming.replay import Replay

QUERIES, ORACLES = {}, {}
HOURLY = WindowSpec(3600, 1800)
def since():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _folder(spark: SparkSession) -> str:
    """A fresh folder where the cluster shares files; a local session without one uses a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="tidewatch-stream-")
    return os.path.join(shared, f"stream-{uuid.uuid4().hex}")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables as a file stream."""
    prepare(spark)
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def flow_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = table_stream(spark, sf, "events").selectExpr("*", f"{fixtures._K} as k")
    raw = base.selectExpr(*(f"{text} as {name}" for name, text in fixtures.FLOW_SQL.items()))
    return with_stages(raw, INTERNAL, trusted_labels=True)


def packet_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = table_stream(spark, sf, "lineitem").selectExpr(*(f"{text} as {name}" for name, text in fixtures.PACKET_SQL.items()))
    return raw.withColumn("ts", F.timestamp_micros("at_us")).drop("at_us")


def derived_stream(df: DataFrame) -> DataFrame:
    """A batch result written once and streamed back."""
    folder = _folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream until its input is used up; the sink, read back."""
    spark = stream.sparkSession
    folder = _folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    run = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
           .trigger(availableNow=True).start(f"{folder}/rows"))
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def replayed(stream: DataFrame, operator, **closing) -> DataFrame:
    """What ``operator`` makes of a finite stream, with everything that is open at its end."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    replay = Replay(_folder(spark))
    return replay.drain(operator(replay.source(stream, **closing)))


#: closing rows: a key no real row has, and what the operators compute with
FLOW_END = {"split": "", "src_ip": "", "dst_ip": "", "dst_port": 0, "stage": 0}
PACKET_END = {"split": "", "capture": "", "src_ip": "", "dst_ip": "", "src_port": 0, "dst_port": 0, "protocol": 17, "frame_no": 0, "frag_off": 0, "more_frags": False, "payload_len": 0}

# windows on the epoch grid
cte("lw0", "select *, epoch_us(ts) // 1800000000 * 1800000000 - b * 1800000000 as start_us from fx cross join range(2) r(b)")
cte("lw", "select * from lw0 where start_us >= epoch_us(timestamp '2024-01-01 00:00:00')")


@query("live_windows", table(q(
    "select split, start_us as ts, count(*) as n_flows, count(*) / 3600.0 as flows_per_s, sum(fwd_bytes + bwd_bytes) as bytes_total, avg(case when bwd_pkts = 0 then 1.0 else 0 end) as one_way_rate, "
    "case when max(case when s < 6 then s else 0 end) > 0 then max(case when s < 6 then s else 0 end) else max(s) end as stage from (select *, case when attempted then 0 else stage end as s from lw) group by split, start_us"),
    s="split", i="ts n_flows bytes_total stage", d="flows_per_s one_way_rate"))
def live_windows(spark, sf):
    out = replayed(flow_stream(spark, sf), lambda rows: live.live_windows(rows, HOURLY, INTERNAL, since=since()), **FLOW_END)
    return out.select("split", "ts", "n_flows", "flows_per_s", "bytes_total", "one_way_rate", "stage")


@query("live_distinct", table(q("select split, start_us as ts, count(distinct dst_port) as uniq_dst_port, count(*) as n_flows from lw group by split, start_us"),
                              s="split", i="ts uniq_dst_port n_flows"))
def live_distinct(spark, sf):
    return replayed(flow_stream(spark, sf), lambda rows: live.live_distinct(rows, HOURLY, "dst_port", since=since()), **FLOW_END)


@query("live_minute_stages", table(q(
    "select split, at_minute, count(*) filter (where stage = 0) as BENIGN, count(*) filter (where stage = 1) as RECONNAISSANCE from (select *, epoch_us(ts) // 60000000 * 60000000 as at_minute from fx) "
    "group by split, at_minute"), s="split", i="at_minute BENIGN RECONNAISSANCE"))
def live_minute_stages(spark, sf):
    out = replayed(flow_stream(spark, sf), live.live_minute_stages, **FLOW_END)
    return out.select("split", F.col("minute").alias("at_minute"), "BENIGN", "RECONNAISSANCE")


@query("live_threshold", table(q("select split, w, score, threshold, alarm from al"), s="split", i="w alarm", d="score threshold"))
def live_threshold(spark, sf):
    return drained(stateful.live_threshold(derived_stream(scored(spark, sf).select("split", "w", "ts", "score")))).drop("ts")


_F = "(partition by split order by w rows between 120 preceding and 1 preceding)"


def _slope(n):
    f = f"(partition by split order by w rows between {n - 1} preceding and current row)"
    return f"case when count(*) over {f} = {n} then regr_slope(score, w) over {f} else 0 end as score_slope_{n}"


@query("live_trend", table(q(
    f"select split, w, coalesce(score - lag(score) over (partition by split order by w), 0) as score_delta, {_slope(5)}, {_slope(10)}, case when count(*) over " + _F + " >= 10 then greatest(least((score - avg(score) over " + _F +
    ") / greatest(stddev_samp(score) over " + _F + ", 1e-6), 10), -10) else 0 end as score_zscore from sc"), s="split", i="w", d="score_delta score_slope_5 score_slope_10 score_zscore"))
def live_trend(spark, sf):
    return drained(stateful.live_trend(derived_stream(scored(spark, sf).select("split", "w", "score")), ("score",)))


@query("live_first_seen", table(q("select split, src_ip, dst_ip as value, epoch_us(min(ts)) as ts from fx group by split, src_ip, dst_ip"), s="split src_ip value", i="ts"))
def live_first_seen(spark, sf):
    return drained(stateful.live_first_seen(flow_stream(spark, sf), "dst_ip"))


@query("live_alarm_runs", table(q("select split, begin_w, end_w, windows, peak from runs0"), s="split", i="begin_w end_w windows", d="peak"))
def live_alarm_runs(spark, sf):
    a = alarmed(spark, sf).select("split", "w", "ts", "score", "alarm")
    return replayed(derived_stream(a), lambda rows: live.live_alarm_runs(rows, HOURLY), split="", w=-1, alarm=True)


@query("live_port_signatures")
def live_port_signatures(spark, sf):
    """X9 (stateful; unit tests hold it to the batch verdicts)."""
    return drained(stateful.live_port_signatures(packet_stream(spark, sf))).drop("ts")


@query("live_flows", LIVE_FLOW_SQL)
def live_flows(spark, sf):
    """The oracle folds every tuple's packets in order."""
    return replayed(packet_stream(spark, sf), stateful.live_flows, **PACKET_END)


cte("ses0", "select *, case when at_us - lag(at_us) over (partition by split, src_ip, dst_ip, src_port, dst_port, protocol order by at_us) > 120000000 then 1 else 0 end as brk from pk where protocol in (6, 17)")
cte("ses", "select *, sum(brk) over (partition by split, src_ip, dst_ip, src_port, dst_port, protocol order by at_us rows unbounded preceding) as ses from ses0")


@query("live_session_stats", table(q(
    "select split, src_ip, dst_ip, src_port, dst_port, protocol, min(at_us) as first_ts, count(*) as packet_count, avg(ttl) as ttl_mean, var_pop(ttl) as ttl_variance, "
    "coalesce(avg(case when protocol = 6 then tcp_win end), 0) as tcp_win_mean, coalesce(max(case when protocol = 6 then tcp_win end), 0) as tcp_win_max, "
    "count(*) filter (where more_frags or frag_off > 0) as ip_frag_count, count(*) filter (where payload_len <= 64) as payload_0_64, "
    "count(*) filter (where payload_len between 65 and 128) as payload_65_128, count(*) filter (where payload_len between 129 and 512) as payload_129_512, "
    "count(*) filter (where payload_len between 513 and 1024) as payload_513_1024, count(*) filter (where payload_len > 1024) as payload_gt_1024 "
    "from ses group by split, src_ip, dst_ip, src_port, dst_port, protocol, ses"),
    s="split src_ip dst_ip", i="src_port dst_port protocol first_ts packet_count ip_frag_count payload_0_64 payload_65_128 payload_129_512 payload_513_1024 payload_gt_1024",
    d="ttl_mean ttl_variance tcp_win_mean tcp_win_max"))
def live_session_stats(spark, sf):
    return replayed(packet_stream(spark, sf), live.live_session_stats, **PACKET_END)
