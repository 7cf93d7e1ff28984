"""Windows, state vector and optional blocks: literal cases, brute force, and independence of partitioning."""

import math
import random
from collections import defaultdict
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from tidewatch import Grid, WindowSpec
from tidewatch.operators import blocks, grid as grid_ops, state
from tidewatch.schema import BASE_FEATURES, FEATURE_BLOCKS, TREND_FEATURES, select_features, validate_flows

INSIDE = ("192.168.10.",)


def test_spec_rejects_gaps():
    with pytest.raises(ValueError):
        WindowSpec(20, 30)
    with pytest.raises(ValueError):
        WindowSpec(0, 0)
    spec = WindowSpec(60, 45)
    assert spec.slice_us == 15_000_000 and spec.windows_per_instant == 2 and spec.n_windows(100) == 3


def test_flow_at_75_seconds_is_in_windows_1_and_2(make_flows):
    flows = make_flows([{"at": 0}, {"at": 75}])
    g = Grid.fit(flows)
    rows = g.expand(flows).where("unix_micros(ts) % 60000000 <> 0").collect()
    assert sorted(r["w"] for r in rows) == [1, 2]
    assert g.spans.first()["n"] == 3


@pytest.mark.parametrize("length,stride", [(60, 30), (60, 45), (50, 20), (30, 30)])
def test_membership_matches_the_definition(make_flows, length, stride):
    rng = random.Random(length * 100 + stride)
    at = sorted(round(rng.uniform(0, 400), 6) for _ in range(60)) + [float(stride), float(length)]
    flows = make_flows([{"at": a} for a in [0.0, *at]])
    g = Grid.fit(flows, WindowSpec(length, stride))
    got = {(round((r["ts"] - T0).total_seconds() * 1e6), r["w"]) for r in g.expand(flows).collect()}
    want = set()
    for a in [0.0, *at]:
        us = round(a * 1e6)
        for w in range(0, 1000):
            if w * stride * 10**6 <= us < (w * stride + length) * 10**6:
                want.add((us, w))
    assert got == want


def test_rows_before_a_given_anchor_belong_nowhere(spark, make_flows):
    flows = make_flows([{"at": 0}, {"at": 100}])
    spans = spark.createDataFrame([("d", T0 + timedelta(seconds=60), 4)], "split string, t0 timestamp, n int")
    rows = Grid.of(spans).expand(flows).collect()
    assert sorted(r["w"] for r in rows) == [0, 1]


def test_many_splits_take_the_salted_join(make_flows):
    flows = make_flows([{"at": i, "split": f"s{i % 3}"} for i in range(90)])
    g = Grid.fit(flows)
    big = Grid(g.spec, g.spans, False)
    count = lambda x: sorted(map(tuple, x.to_windows(x.locate(flows)).groupBy("split", "w").count().collect()))
    assert count(g) == count(big)


def test_names_and_blocks():
    assert len(BASE_FEATURES) == 70 == len(set(BASE_FEATURES)) and len(TREND_FEATURES) == 24
    kept = select_features(BASE_FEATURES, ["beacon", "direction"])
    assert len(kept) == 66 and "beacon_score" not in kept
    with pytest.raises(ValueError):
        select_features([*BASE_FEATURES, TREND_FEATURES[0]], ["trend"])
    with pytest.raises(ValueError):
        select_features(BASE_FEATURES, ["nonsense"])
    assert set(FEATURE_BLOCKS["not_in_biflow"]) <= set(BASE_FEATURES)


def test_schema_check(make_flows):
    flows = make_flows([{"at": 0}])
    assert validate_flows(flows) is flows
    with pytest.raises(ValueError, match="lack"):
        validate_flows(flows.drop("dst_port"))
    with pytest.raises(ValueError, match="wrong"):
        validate_flows(flows.withColumn("dst_port", F.col("dst_port").cast("string")))


def _random_flows(seed, n=220, hot=0.35):
    """A third of all flows belong to one pair."""
    rng = random.Random(seed)
    rows = [{"at": 0}]
    for _ in range(n):
        busy = rng.random() < hot
        rows.append({
            "at": round(rng.uniform(0, 290), 6), "src_ip": "192.168.10.9" if busy else f"192.168.10.{rng.randint(1, 6)}",
            "dst_ip": "8.8.4.4" if busy else rng.choice(["8.8.8.8", "192.168.10.3", "1.1.1.1"]), "dst_port": rng.choice([80, 81, 82, 443, 5000]),
            "src_port": rng.randint(40000, 40020), "protocol": rng.choice([6, 17]), "fwd_pkts": rng.randint(1, 9), "bwd_pkts": rng.randint(0, 4),
            "fwd_bytes": rng.randint(0, 900), "bwd_bytes": rng.randint(0, 500), "fwd_init_win": rng.choice([0, 512, 8192, 65535]),
            "syn_cnt": rng.randint(0, 2), "ack_cnt": rng.randint(0, 1), "flow_iat_mean": rng.random() * 100, "flow_iat_std": rng.random() * 50})
    return rows


def _entropy(values):
    counts = defaultdict(int)
    for v in values:
        counts[v] += 1
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in counts.values())


@pytest.mark.parametrize("length,stride", [(60, 30), (60, 45)])
def test_state_vector_against_brute_force(make_flows, length, stride):
    rows = _random_flows(7)
    flows = make_flows(rows)
    g = Grid.fit(flows, WindowSpec(length, stride))
    got = {r["w"]: r.asDict() for r in state.state_vector(flows, g, INSIDE).collect()}
    full = [{"src_ip": "192.168.10.5", "dst_ip": "8.8.8.8", "src_port": 40000, "dst_port": 80, "protocol": 6, "fwd_pkts": 0, "bwd_pkts": 0,
             "fwd_bytes": 0, "bwd_bytes": 0, "fwd_init_win": 0, "syn_cnt": 0, "ack_cnt": 0} | r for r in rows]
    assert sorted(got) == list(range(len(got)))
    for w, row in got.items():
        inside = [r for r in full if w * stride <= r["at"] < w * stride + length]
        if not inside:
            assert all(row[c] == 0 for c in BASE_FEATURES)
            continue
        n = len(inside)
        wins = [r["fwd_init_win"] for r in inside]
        mean = sum(wins) / n
        want = {
            "n_flows": n, "bytes_total": sum(r["fwd_bytes"] + r["bwd_bytes"] for r in inside),
            "uniq_src_ip": len({r["src_ip"] for r in inside}), "uniq_src_port": len({r["src_port"] for r in inside}),
            "dst_port_entropy": _entropy([r["dst_port"] for r in inside]), "src_ip_entropy": _entropy([r["src_ip"] for r in inside]),
            "fwd_init_win_std": math.sqrt(sum((x - mean) ** 2 for x in wins) / (n - 1)) if n > 1 else 0.0,
            "syn_no_ack_rate": sum(r["syn_cnt"] > 0 and r["ack_cnt"] == 0 for r in inside) / n}
        pairs, ports = defaultdict(list), defaultdict(set)
        for r in inside:
            pairs[r["src_ip"], r["dst_ip"]].append(r["at"])
            ports[r["src_ip"], r["dst_ip"]].add(r["dst_port"])
        hits = sum(p + 1 in s for s in ports.values() for p in s)
        total = sum(len(s) - 1 for s in ports.values())
        want["seq_port_ratio"] = hits / total if total else 0.0
        want["ports_per_pair_max"] = max(map(len, ports.values()))
        scores = []
        for times in pairs.values():
            gaps = [b - a for a, b in zip(sorted(times), sorted(times)[1:])]
            if len(gaps) >= 3:
                m = sum(gaps) / len(gaps)
                sd = math.sqrt(sum((x - m) ** 2 for x in gaps) / (len(gaps) - 1))
                scores.append(1 / (1 + sd / (m + 1e-6)))
        want["beacon_score"] = max(scores, default=0.0)
        for name, value in want.items():
            assert row[name] == pytest.approx(value, abs=1e-7), (w, name)


def test_result_does_not_depend_on_partitioning(spark, make_flows):
    flows = make_flows(_random_flows(11))
    want = None
    for parts in (1, 3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        f = flows.repartition(parts)
        rows = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in state.state_vector(f, Grid.fit(f), INSIDE).collect())
        assert want is None or rows == want
        want = rows
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conservation(make_flows):
    flows = make_flows(_random_flows(3))
    g = Grid.fit(flows)
    row = grid_ops.conservation(flows, state.volume_features(flows, g, INSIDE), g).first()
    assert row["conserved"] and row["flows"] == 221
    offsets = [r["at"] for r in _random_flows(3)]
    assert row["memberships"] == 2 * 221 - sum(a < 30 for a in offsets)


def test_stage_of_windows(make_flows):
    flows = make_flows([{"at": 0}, {"at": 10}, {"at": 200, "stage": 3}, {"at": 300, "stage": 4, "attempted": True},
                        {"at": 400, "stage": 6}, {"at": 401, "stage": 2}, {"at": 500, "stage": 6}])
    g = Grid.fit(flows)
    stages = {r["w"]: r for r in state.window_stages(flows, g).collect()}
    assert stages[0]["stage"] == 0 and stages[1]["stage"] == 0 and stages[6]["stage"] == 3
    assert stages[10]["stage"] == 0 and stages[10]["stage_BENIGN"] == 1
    assert stages[13]["stage"] == 2 and stages[13]["stage_IMPACT"] == 1 and stages[16]["stage"] == 6
    attempted = {r["w"]: r["stage"] for r in state.window_stages(flows, g, include_attempted=True).collect()}
    assert attempted[10] == 4


def test_trend_of_a_ramp(spark):
    rows = [("d", w, 3.0 * w) for w in range(20)]
    states = spark.createDataFrame(rows, "split string, w bigint, x double")
    out = {r["w"]: r for r in blocks.trend_features(states, bases=("x",)).collect()}
    assert out[0]["x_delta"] == 0 and out[1]["x_delta"] == 3
    assert out[3]["x_slope_5"] == 0 and out[4]["x_slope_5"] == pytest.approx(3) and out[9]["x_slope_10"] == pytest.approx(3)
    assert out[9]["x_zscore"] == 0 and out[10]["x_zscore"] > 0


def test_host_slots_rank_internal_hosts_only(make_flows):
    rows = [{"at": 1, "src_ip": "9.9.9.9", "dst_ip": "192.168.10.1"}] * 5
    rows += [{"at": 2, "src_ip": "192.168.10.7", "dst_ip": "8.8.8.8"}] * 3 + [{"at": 3, "src_ip": "192.168.10.2", "dst_ip": f"1.1.1.{i}"} for i in range(2)]
    flows = make_flows(rows)
    row = blocks.host_slots(flows, Grid.fit(flows), INSIDE, 3).where("w = 0").first()
    assert row["host1_fanout"] == 1 and row["host2_fanout"] == 2 and row["host3_fanout"] == 0


def test_new_peer_rate(make_flows):
    peer = {"src_ip": "192.168.10.7"}
    flows = make_flows([{"at": 5, "dst_ip": "8.8.8.8"} | peer, {"at": 125, "dst_ip": "8.8.8.8"} | peer, {"at": 126, "dst_ip": "1.1.1.1"} | peer,
                        {"at": 245, "dst_ip": "8.8.8.8"} | peer])
    rate = {r["w"]: r["host1_new_peer_rate"] for r in blocks.host_slots(flows, Grid.fit(flows), INSIDE, 1).collect()}
    assert rate[0] == 1.0 and rate[3] == 0.5 and rate[8] == 0.0


def test_host_relative_when_some_hosts_stay_silent(spark, make_flows):
    """Brute force over the dense host x window table, with a host that is silent for longer than the baseline."""
    rng = random.Random(5)
    rows = [{"at": 0, "src_ip": "192.168.10.1"}, {"at": 3, "src_ip": "192.168.10.99", "dst_port": 9}, {"at": 2380, "src_ip": "192.168.10.2"}]
    for _ in range(260):
        rows.append({"at": rng.uniform(0, 2390), "src_ip": f"192.168.10.{rng.randint(1, 3)}", "dst_ip": f"8.8.8.{rng.randint(1, 9)}",
                     "dst_port": rng.randint(1, 12)})
    flows = make_flows(rows)
    g = Grid.fit(flows)
    got = {r["w"]: r for r in blocks.host_relative_features(flows, g, INSIDE, baseline=20, min_periods=10).collect()}
    n = len(got)
    hosts = sorted({r["src_ip"] for r in rows})
    sets = {(h, w): [r for r in rows if r["src_ip"] == h and w * 30 <= r["at"] < w * 30 + 60] for h in hosts for w in range(n)}
    ports = {k: len({r.get("dst_port", 80) for r in v}) for k, v in sets.items()}
    count = {k: len(v) for k, v in sets.items()}
    for w in range(n):
        z, ratio = [], [0.0]
        for h in hosts:
            past = [ports[h, v] for v in range(max(0, w - 20), w)]
            if len(past) >= 10:
                m = sum(past) / len(past)
                sd = math.sqrt(sum((x - m) ** 2 for x in past) / (len(past) - 1))
                z.append(max(-10, min(10, (ports[h, w] - m) / max(sd, 1.0))))
                flows_past = [count[h, v] for v in range(max(0, w - 20), w)]
                ratio.append(count[h, w] / (1 + sum(flows_past) / len(flows_past)))
        assert got[w]["hostrel_ports_z_max"] == pytest.approx(max(z) if z else 0.0, abs=1e-9), w
        assert got[w]["hostrel_flows_ratio_max"] == pytest.approx(max(ratio), abs=1e-9), w
