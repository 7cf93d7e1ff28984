"""Packets -> flows -> states: statistics taken stretch by stretch equal those of whole flows, and no step leaves its shuffles behind."""

import os
import random
import statistics
import time
from datetime import datetime, timedelta

import pytest

from tidewatch import WindowSpec
from tidewatch.operators import flows
from tidewatch.operators.packets import packet_window_features, retransmissions_by_slice, with_retransmissions
from tidewatch.operators.grid import Grid
from tidewatch.plans import build
from tidewatch.session import SHUFFLES_GO, cut_lineage, kept_apart

SCHEMA = ("split string, capture string, frame_no long, ts timestamp, src_ip string, dst_ip string, protocol int, src_port int, dst_port int, ttl int, "
          "more_frags boolean, frag_off int, tcp_flags int, seq long, tcp_win int, hdr_len int, payload_len int")


def made(rng, n, tuples=12, nulls=0.1):
    """Packets of a few tuples, one with most of them, some values missing."""
    ips, rows = [f"192.168.10.{i}" for i in range(3)] + ["8.8.8.8", None], []
    kinds = [(*rng.sample(ips, 2), rng.choice([6, 6, 17]), rng.randrange(1, 4), rng.choice([80, 443, None])) for _ in range(tuples)]

    def some(value):
        return None if rng.random() < nulls else value

    for frame in range(n):
        src, dst, protocol, sport, dport = kinds[0] if rng.random() < 0.6 else rng.choice(kinds)
        if rng.random() < 0.5:
            src, dst, sport, dport = dst, src, dport, sport
        at = datetime(2024, 1, 1) + timedelta(microseconds=frame * 700_000 + rng.randrange(2_000_000))
        rows.append(("s", "c", frame, at, src, dst, protocol, sport, dport, 64, False, 0, some(rng.choice([2, 16, 16, 16, 17, 4, 18])),
                     rng.randrange(3000), some(rng.randrange(5) * 100), some(rng.choice([20, 32])), some(rng.choice([0, 0, 40, 700]))))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small_pieces(spark):
    """Many stretches, and batches that cut through flows."""
    before = {"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.shuffle.partitions": "4", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    for key, value in zip(before, ("false", "9", "17")):
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def deviation(values):
    values = [v for v in values if v is not None]
    return statistics.stdev(values) if len(values) > 1 else 0.0


def by_hand(rows):
    """Flows of assigned packets, each summed up at once."""
    tuples, out = {}, []
    for r in rows:
        tuples.setdefault(tuple(r[k] for k in flows.ENDS), {}).setdefault(r.flow_no, []).append(r)
    for key, parts in tuples.items():
        way = None
        for number in sorted(parts):
            own = sorted(parts[number], key=lambda r: r.place)
            first = own[0]
            if (number == 0 or (first.protocol == 6 and first.tcp_flags & 2 and not first.tcp_flags & 16)) and first.from_a is not None:
                way = first.from_a
            if len(own) < 2:
                continue
            there = [r for r in own if r.from_a is not None]
            fwd, bwd = ([r for r in there if r.from_a == (way is side)] for side in (True, False))
            a, b = (key[2], key[3]), (key[4], key[5])

            def total(side, column):
                values = [r[column] if r in side else 0 for r in own]
                return sum(v for v in values if v is not None) if any(v is not None for v in values) else None

            def window(side, at):
                return (side[at].tcp_win or 0) if side and side[at].protocol == 6 else 0

            pays, gaps = [r.payload_len for r in own], [r.gap for r in own]
            known = [p for p in pays if p is not None]
            iat = ["a_gap" if way is side else "b_gap" for side in (True, False)]
            out.append((
                first.us, *(a if way is True else b), *(a if way is False else b), first.protocol, float(own[-1].us - first.us), len(fwd), len(bwd),
                total(fwd, "payload_len"), total(bwd, "payload_len"), statistics.fmean(gaps[1:]), deviation(gaps), float(max(gaps[1:])), float(min(gaps[1:])),
                *(sum(r.protocol == 6 and bool(r.tcp_flags & bit) for r in own) for bit in flows.FLAG_COLUMNS),
                float(min(known, default=0)), float(max(known, default=0)), statistics.fmean(known) if known else 0.0, deviation(pays),
                window(fwd, 0), window(bwd, -1), min((r.hdr_len for r in fwd if r.hdr_len is not None), default=0),
                statistics.fmean(v) if (v := [r.active for r in own if r.active is not None]) else 0.0,
                statistics.fmean(v) if (v := [r.idle for r in own if r.idle is not None]) else 0.0,
                deviation([r.payload_len for r in fwd]), deviation([r.payload_len for r in bwd]), *(deviation([r[c] for r in own]) for c in iat),
                sum(r.protocol == 6 and bool(r.tcp_flags & 4) for r in fwd), sum(r.protocol == 6 and bool(r.tcp_flags & 4) for r in bwd), total(fwd, "hdr_len"),
                sum((r.payload_len or 0) > 0 for r in fwd) - bool(fwd and (fwd[0].payload_len or 0) > 0)))
    return out


COLUMNS = ("src_ip src_port dst_ip dst_port protocol duration_us fwd_pkts bwd_pkts fwd_bytes bwd_bytes flow_iat_mean flow_iat_std flow_iat_max flow_iat_min "
           "fin_cnt syn_cnt rst_cnt psh_cnt ack_cnt urg_cnt ece_cnt cwr_cnt pkt_len_min pkt_len_max pkt_len_mean pkt_len_std fwd_init_win bwd_init_win fwd_seg_size_min "
           "active_mean idle_mean fwd_pkt_len_std bwd_pkt_len_std fwd_iat_std bwd_iat_std fwd_rst_cnt bwd_rst_cnt fwd_hdr_bytes fwd_data_pkts").split()


def plain(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_flows_cut_by_stretches_and_batches_have_the_statistics_of_whole_flows(small_pieces, seed):
    packets = small_pieces.createDataFrame(made(random.Random(seed), 1500), SCHEMA)
    assigned = flows.assign_flows(packets).collect()
    got = flows.assemble_flows(packets).selectExpr("unix_micros(ts) as us", *COLUMNS).collect()
    expected = by_hand(assigned)
    assert len(expected) > 50 and plain(got) == plain(expected)


def test_flows_are_read_without_a_shuffle(spark):
    packets = spark.createDataFrame(made(random.Random(3), 400), SCHEMA)
    assert "Exchange" not in flows.assemble_flows(packets)._jdf.queryExecution().executedPlan().toString()


def test_counted_retransmissions_equal_marked_ones(small_pieces):
    packets = small_pieces.createDataFrame(made(random.Random(4), 900, nulls=0.0), SCHEMA)
    grid = Grid.fit(packets, WindowSpec(60, 30))
    marked = packet_window_features(with_retransmissions(packets), grid).collect()
    counted = packet_window_features(packets, grid, retransmissions_by_slice(packets, grid)).collect()
    assert any(r.pcap_retrans_rate > 0 for r in marked)
    assert plain(counted) == plain(marked)


def shuffled_bytes(spark):
    """Bytes of shuffle files now on disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = [os.path.join(folder, n) for top in (str(d) for d in blocks.localDirs()) for folder, _, names in os.walk(top) for n in names if n.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def settled(spark, limit, seconds=10):
    until = time.time() + seconds
    while (now := shuffled_bytes(spark)) > limit and time.time() < until:
        time.sleep(0.2)
    return now


def test_a_step_kept_apart_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    before, setting = shuffled_bytes(spark), spark.conf.get(SHUFFLES_GO)
    out = kept_apart(spark.range(200_000).selectExpr("id", "rand(1) as k").repartition("k"))
    assert settled(spark, before + 1000) <= before + 1000
    assert out.count() == 200_000 and spark.conf.get(SHUFFLES_GO) == setting


def test_states_from_packets_leave_no_shuffle_of_packets_on_disk(spark):
    packets = cut_lineage(spark.createDataFrame(made(random.Random(5), 12_000), SCHEMA))
    before = shuffled_bytes(spark)
    states, _ = build.states_from_packets(packets, ("192.168.10.",), WindowSpec(60, 30))
    left = settled(spark, before + 60_000)
    assert left <= before + 60_000  # 358 kB when each query's shuffles stayed
    assert states.where("pcap_pkts > 0").count() > 0
