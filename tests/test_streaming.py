"""Streams replayed from files give what the batch operators give."""

import os
import random
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from tidewatch import WindowSpec
from tidewatch.operators import alerts, blocks, flows as assembly
from tidewatch.streaming import live, stateful
from tidewatch.streaming.replay import Replay

COUNT = iter(range(10**6))


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Write a frame as files in the given order, stream them one per micro-batch, and return what came out."""

    def run(df, order, transform, files=4, mode="append"):
        folder = tmp_path_factory.mktemp("replay")
        rows = df.orderBy(order).collect()
        size = -(-len(rows) // files)
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            for name in os.listdir(folder / "in"):  # file order is modification-time order
                if name.endswith(".parquet") and not name.startswith("f"):
                    os.rename(folder / "in" / name, folder / "in" / f"f{i:06d}-{name}")
                    os.utime(folder / "in" / f"f{i:06d}-{name}", (1000 + i, 1000 + i))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        query = (transform(stream).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", str(folder / "ck"))
                 .trigger(availableNow=True).start(str(folder / "out")))
        query.awaitTermination(240)
        assert query.exception() is None
        run.query = query
        return spark.read.parquet(str(folder / "out"))

    return run


@pytest.fixture(scope="module")
def flows(make_flows):
    rng = random.Random(12)
    return make_flows([{"at": round(rng.uniform(0, 900), 3), "src_ip": f"192.168.10.{rng.randint(1, 5)}", "dst_ip": f"8.8.8.{rng.randint(1, 6)}",
                        "dst_port": rng.randint(1, 30), "fwd_bytes": rng.randint(1, 99), "stage": rng.choice([0, 0, 0, 1, 3])} for _ in range(400)]).cache()


def test_live_windows_equal_batch(replay, flows):
    spec = WindowSpec(60, 30)
    out = replay(flows, "ts", lambda s: live.live_windows(s, spec, ("192.168.10.",), since=F.lit(T0)))
    got = {r["ts"]: (r["n_flows"], r["bytes_total"], r["stage"], round(r["is_outbound_rate"], 9)) for r in out.collect()}
    rows = flows.collect()
    last = max(r["ts"] for r in rows) - timedelta(seconds=60)
    assert len(got) > 20 and min(got) >= T0
    for start, value in got.items():
        inside = [r for r in rows if start <= r["ts"] < start + timedelta(seconds=60)]
        assert value == (len(inside), sum(r["fwd_bytes"] for r in inside), max(r["stage"] for r in inside), 1.0)
    closed = {T0 + timedelta(seconds=30 * k) for k in range(100)} & {s for s in got}
    assert closed == {T0 + timedelta(seconds=30 * k) for k in range(100) if T0 + timedelta(seconds=30 * k + 60) <= last
                      and any(T0 + timedelta(seconds=30 * k) <= r["ts"] < T0 + timedelta(seconds=30 * k + 60) for r in rows)} | (closed - {
                          T0 + timedelta(seconds=30 * k) for k in range(100) if T0 + timedelta(seconds=30 * k + 60) <= last})


def test_live_distinct_is_exact(replay, flows):
    out = replay(flows, "ts", lambda s: live.live_distinct(s, WindowSpec(60, 30), "dst_port", since=F.lit(T0)))
    rows = flows.collect()
    got = out.collect()
    assert len(got) > 15
    for r in got:
        inside = [f for f in rows if r["ts"] <= f["ts"] < r["ts"] + timedelta(seconds=60)]
        assert (r["uniq_dst_port"], r["n_flows"]) == (len({f["dst_port"] for f in inside}), len(inside))


def test_live_minute_stages(replay, flows):
    got = {r["minute"]: r["LATERAL_MOVEMENT"] for r in replay(flows, "ts", live.live_minute_stages).collect()}
    rows = flows.collect()
    assert len(got) >= 10
    for minute, count in got.items():
        assert count == sum(r["stage"] == 3 and minute <= r["ts"] < minute + timedelta(minutes=1) for r in rows)


def test_late_rows_are_dropped_and_counted(spark, replay, flows):
    late = flows.withColumn("_o", F.unix_micros("ts")).unionByName(
        flows.limit(3).withColumns({"ts": F.lit(T0 - timedelta(days=1)), "_o": F.lit(9 * 10**18)}))
    replay(late, "_o", lambda s: live.live_minute_stages(s.drop("_o")))
    assert live.late_rows(replay.query) >= 1


def test_live_threshold_equals_batch(replay, make_scores):
    rng = random.Random(3)
    scores = make_scores([rng.random() for _ in range(120)]).withColumn("ts", F.timestamp_micros(F.lit(1704067200000000) + F.col("w") * 30000000))
    got = {r["w"]: (r["threshold"], r["alarm"]) for r in replay(scores, "w", stateful.live_threshold).collect()}
    for r in alerts.causal_threshold(scores).collect():
        threshold, alarm = got[r["w"]]
        assert alarm == r["alarm"] and (threshold is None) == (r["threshold"] is None)
        assert threshold is None or threshold == pytest.approx(r["threshold"], abs=1e-12)


def test_live_trend_equals_batch(spark, replay):
    rng = random.Random(4)
    states = spark.createDataFrame([(s, w, rng.random() * 5) for s in ("a", "b") for w in range(150)], "split string, w bigint, x double")
    got = {(r["split"], r["w"]): r for r in replay(states, "w", lambda s: stateful.live_trend(s, ("x",))).collect()}
    for r in blocks.trend_features(states, bases=("x",)).collect():
        live_row = got[r["split"], r["w"]]
        for kind in ("delta", "slope_5", "slope_10", "zscore"):
            assert live_row[f"x_{kind}"] == pytest.approx(r[f"x_{kind}"], abs=1e-9), kind


def test_trend_in_one_large_batch(spark, replay):
    """More rows at once than are worked on together, and window numbers with a hole."""
    rng = random.Random(6)
    states = spark.createDataFrame([("a", w, rng.random() * 5) for w in range(1300) if w not in (700, 701)], "split string, w bigint, x double")
    got = {r["w"]: r for r in replay(states, "w", lambda s: stateful.live_trend(s, ("x",)), files=1).collect()}
    rows = blocks.trend_features(states, bases=("x",)).collect()
    assert len(got) == len(rows) == 1298
    for r in rows:
        for kind in ("delta", "slope_5", "slope_10", "zscore"):
            assert got[r["w"]][f"x_{kind}"] == pytest.approx(r[f"x_{kind}"], abs=1e-9), kind


def test_replay_reports_what_is_open_at_the_end(spark, tmp_path, flows, packet_rows):
    def ended(df, operator, name, **closing):
        df.write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        replayed = Replay(str(tmp_path / f"{name}-run"))
        return replayed.drain(operator(replayed.source(stream, **closing))).collect()

    minutes = ended(flows.repartition(1), live.live_minute_stages, "minutes", split="", stage=0)
    want = flows.groupBy("split", F.date_trunc("minute", "ts").alias("minute")).agg(F.count_if(F.col("stage") == 3).alias("c")).collect()
    assert {(r["split"], r["minute"], r["LATERAL_MOVEMENT"]) for r in minutes} == {tuple(r) for r in want}

    found = ended(packet_rows.repartition(1), stateful.live_flows, "packets", split="", capture="", src_ip="", dst_ip="", src_port=0, dst_port=0,
                  protocol=17, frame_no=0, frag_off=0, payload_len=0)
    batch = assembly.assemble_flows(packet_rows).select("ts", "src_ip", F.expr("fwd_pkts + bwd_pkts"), F.expr("fwd_bytes + bwd_bytes")).collect()
    assert sorted((r["first_ts"], r["ip_a"] if r["from_a"] else r["ip_b"], r["pkts"], r["a_bytes"] + r["b_bytes"]) for r in found) == sorted(tuple(r) for r in batch)


def test_replay_of_an_empty_table_is_empty(spark, tmp_path, flows):
    flows.limit(0).write.parquet(str(tmp_path / "none"))
    replayed = Replay(str(tmp_path / "run"))
    stream = replayed.source(spark.readStream.schema(flows.schema).parquet(str(tmp_path / "none")), split="", stage=0)
    assert replayed.drain(live.live_minute_stages(stream)).count() == 0
    with pytest.raises(ValueError, match="no columns"):
        replayed.source(stream, colour=1)


def test_first_seen(replay, flows):
    got = replay(flows, "ts", lambda s: stateful.live_first_seen(s, "dst_ip")).collect()
    want = {(r["src_ip"], r["dst_ip"]): r["t"] for r in flows.groupBy("src_ip", "dst_ip").agg(F.min("ts").alias("t")).collect()}
    assert {(r["src_ip"], r["value"]): r["ts"] for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def packet_rows(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        a = rng.random() < .6
        src, dst, sp, dp = ("10.0.0.1", "9.9.9.9", 5, 80) if a else ("9.9.9.9", "10.0.0.1", 80, 5)
        if rng.random() < .3:
            src, dst, sp, dp = "10.0.0.2", "8.8.8.8", 7, 1000 + i
        rows.append(("d", "c", i, T0 + timedelta(seconds=i * 1.5), src, dst, 6, sp, dp, 64, False, 0, rng.choice([2, 16, 16, 16, 17, 4, 16, 24]), i, 100, 20, i % 7))
    from tidewatch.schema import PACKET_SCHEMA
    names = ["split", "capture", "frame_no", "ts", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "ttl", "more_frags", "frag_off", "tcp_flags", "seq", "tcp_win", "hdr_len", "payload_len"]
    kinds = {f.name: f.dataType.simpleString() for f in PACKET_SCHEMA}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names)).cache()


def test_live_flows_equal_batch(replay, packet_rows):
    got = replay(packet_rows, "frame_no", stateful.live_flows, files=5).collect()
    batch = {(r["ts"], r["src_ip"], r["src_port"]): (r["fwd_pkts"], r["bwd_pkts"], r["fwd_bytes"], r["bwd_bytes"]) for r in assembly.assemble_flows(packet_rows).collect()}
    assert len(got) > 20
    for r in got:
        fwd = "a" if r["from_a"] else "b"
        back = "b" if r["from_a"] else "a"
        assert batch[r["first_ts"], r[f"ip_{fwd}"], r[f"port_{fwd}"]] == (r[f"{fwd}_pkts"], r[f"{back}_pkts"], r[f"{fwd}_bytes"], r[f"{back}_bytes"])
    # every flow that ended before the final watermark has been reported
    missing = set(batch) - {(r["first_ts"], r[f"ip_{'a' if r['from_a'] else 'b'}"], r[f"port_{'a' if r['from_a'] else 'b'}"]) for r in got}
    assert all(t > T0 + timedelta(seconds=499 * 1.5 - 120 - 60 - 1) for t, *_ in missing)


def test_live_port_signatures(replay, packet_rows):
    out = replay(packet_rows, "frame_no", stateful.live_port_signatures)
    last = {r["src_ip"]: r["signature"] for r in out.orderBy("ts").collect()}
    want = {r["src_ip"]: r["signature"] for r in assembly.port_scan_signatures(packet_rows).collect()}
    assert last == want


def test_live_session_stats(replay, packet_rows):
    out = replay(packet_rows, "frame_no", lambda s: live.live_session_stats(s, gap="1 second"))
    assert out.count() > 100 and out.where("packet_count = 1 and ttl_mean = 64 and ttl_variance = 0").count() == out.count()


def test_live_alarm_runs(spark, replay):
    alarm = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    rows = [("d", w, T0 + timedelta(seconds=30 * w), w / 10, bool(a)) for w, a in enumerate(alarm)]
    df = spark.createDataFrame(rows, "split string, w bigint, ts timestamp, score double, alarm boolean")
    got = {(r["begin_w"], r["end_w"]) for r in replay(df, "w", lambda s: live.live_alarm_runs(s, WindowSpec(60, 30))).collect()}
    assert got == {(1, 2), (4, 4), (7, 9)}
