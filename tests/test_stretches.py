"""Rules along an order, walked by many tasks: equal to one walk over all rows."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import flows
from tidewatch.operators.stretches import STRETCH, speculate

FLAGS = [0x10, 0x10, 0x10, 0x02, 0x02, 0x11, 0x11, 0x14, 0x04, 0x12, 0x00]
T0 = datetime(2024, 1, 1)


def walk(packets):
    """F1 by one loop: per packet the flow number; and what is open after the last one."""
    out, state = [], None
    for us, flags, from_a in packets:
        syn = bool(flags & 2) and not flags & 16
        if state is None:
            state = [us, False, False, False, 0]
        elif us - state[0] > flows.TIMEOUT_US or (syn and (state[3] or (state[1] and state[2]))):
            state = [us, False, False, False, state[4] + 1]
        if flags & 1:
            state[1 if from_a else 2] = True
        state[3] = state[3] or bool(flags & 4)
        out.append(state[4])
    return out, state


def stream(rng, n, step=None):
    """Random packets of one tuple: bursts, pauses, times out of order, every mix of FIN, SYN and RST."""
    at, out = 1_700_000_000_000_000, []
    quiet = rng.random() < 0.4
    for _ in range(n):
        at += step or rng.choice([1000, 200_000, 6_000_000, 30_000_000, 119_999_999, 120_000_000, 120_000_001])
        shift = rng.choice([0, 0, 0, 0, -1_000_000, -250_000_000, 130_000_000]) if not step else 0
        out.append((at + shift, 0x10 if quiet else rng.choice(FLAGS), rng.random() < 0.6))
    return out


def arrays(packets, begins=(0,)):
    us, flags, from_a = (np.array(c) for c in zip(*packets))
    return flows.Packets(us.astype(np.int64), flags.astype(np.int64), from_a.astype(bool), np.array(begins, np.int64))


def test_chained_summaries_end_in_the_state_of_one_walk():
    rng = random.Random(1)
    for _ in range(400):
        packets = stream(rng, rng.randint(1, 60), rng.choice([None, None, 50_000_000, 119_000_000]))
        state, a = None, 0
        while a < len(packets):
            b = min(len(packets), a + rng.randint(1, 15))
            state = flows.Summary(arrays(packets[a:b])).after(state)
            numbers, (first, fin_a, fin_b, rst, number) = walk(packets[:b])
            closing = 3 if rst or (fin_a and fin_b) else fin_a + 2 * fin_b
            own = [p for p, k in zip(packets[:b], numbers) if k == number]
            a_times, b_times = ([p[0] for p in own if p[2] == side] for side in (True, False))
            opened = own[0][0]
            for p, q in zip(own, own[1:]):
                opened = q[0] if q[0] - p[0] > flows.ACTIVITY_US else opened
            assert state == (first, closing, number, own[-1][0], a_times[-1] if a_times else flows.NEVER, b_times[-1] if b_times else flows.NEVER, opened)
            a = b


def test_next_flow_by_arrays_equals_a_loop_over_segments():
    rng = random.Random(2)
    for _ in range(150):
        parts = [stream(rng, rng.randint(1, 20)) for _ in range(rng.randint(1, 6))]
        begins = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        got = arrays([x for p in parts for x in p], begins).nexts()
        for part, at in zip(parts, begins):
            for i in range(len(part)):
                numbers, _ = walk(part[i:])
                expected = next((k for k, v in enumerate(numbers) if v == 1), len(part) - i)
                assert got[at + i] == at + i + expected


def by_hand(packets):
    """Per packet: flow number, gap, idle, gap to the same end's packet before, active time ended."""
    numbers, _ = walk([p[:3] for p in packets])
    out, prev, own, opened, last = [], {}, {}, {}, None
    for (us, _, from_a, _), k in zip(packets, numbers):
        if k != last:
            prev, own, opened, last = None, {}, us, k
            out.append((k, None, None, None, None))
        else:
            pause = us - prev > flows.ACTIVITY_US
            out.append((k, abs(us - prev), us - prev if pause else None, abs(us - own[from_a]) if from_a in own else None, prev - opened if pause and prev > opened else None))
            opened = us if pause else opened
        prev, own[from_a] = us, us
    return out


@pytest.mark.parametrize("step", [None, 40_000_000], ids=["every mix", "never pauses"])
def test_a_tuple_with_most_packets_spreads_over_all_tasks(spark, step):
    rng = random.Random(3)
    hot = [(*p, n) for n, p in enumerate(stream(rng, 6000, step))]
    rows = [("hot", us, flags, from_a, n) for us, flags, from_a, n in hot]
    cold = {}
    for k in range(40):
        cold[f"c{k:02d}"] = [(*p, 10_000 + n) for n, p in enumerate(stream(rng, rng.randint(1, 12)))]
        rows += [(f"c{k:02d}", us, flags, from_a, n) for us, flags, from_a, n in cold[f"c{k:02d}"]]
    rng.shuffle(rows)
    made = [("s", name if a else "zz", "zz" if a else name, 1 if a else 2, 2 if a else 1, 6, flags, n, "cap", T0 + timedelta(microseconds=us - 1_700_000_000_000_000), 0, 40, 100, 0)
            for name, us, flags, a, n in rows]
    packets = spark.createDataFrame(made, "split string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, tcp_flags int, frame_no long, capture string, "
                                          "ts timestamp, frag_off int, hdr_len int, tcp_win int, payload_len int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = flows.assign_flows(packets).withColumn("stretch", F.shiftright("place", 40)).collect()
        whole = flows.assemble_flows(packets, keep_single=True).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    per_task = {}
    for r in got:
        if "hot" in (r.ip_a, r.ip_b):
            per_task[r.stretch] = per_task.get(r.stretch, 0) + 1
    assert len(per_task) >= 10 and max(per_task.values()) < 1200
    flow_count = 0
    for name, packets_of in {"hot": hot, **cold}.items():
        mine = sorted((r for r in got if name in (r.ip_a, r.ip_b)), key=lambda r: r.frame_no)
        assert [r.place for r in mine] == sorted(r.place for r in mine)
        expected = by_hand(packets_of)
        assert [(r.flow_no, r.gap, r.idle, r.a_gap if r.from_a else r.b_gap, r.active) for r in mine] == expected
        flow_count += expected[-1][0] + 1
    assert whole == flow_count


def test_speculation_equals_one_walk_and_keeps_every_row(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", i, rng.randrange(90) if rng.random() < 0.9 else None) for i in range(5000)]
    rows += [("never", i, -1) for i in range(5000, 5600)]

    def start():
        return deque(maxlen=20)

    def step(recent, value):
        if value is None or value in recent:
            return recent, int(value is not None)
        recent = deque(recent, maxlen=20)
        recent.append(value)
        return recent, 0

    df = spark.createDataFrame(rows, "key string, at long, value long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = speculate(df, ["key"], ["at"], ["value"], start, step, "again").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    states, expected = {}, {}
    for key, at, value in rows:
        states[key], expected[at] = step(states.get(key, start()), value)
    assert {r["at"]: r.again for r in got} == expected and len(got) == len(rows)
    assert STRETCH not in got[0]


def test_retransmissions_equal_a_fold_whatever_the_steps(spark):
    rng, rows, expected = random.Random(5), [], {}
    for name in ("hot", "b", "c", "d"):
        furthest, seq = None, rng.randrange(1 << 32)
        for i in range(900 if name == "hot" else 60):
            seq = (seq + rng.choice([100, 100, 100, -300, 1 << 31, (1 << 31) - 1, -(1 << 31) + 50, (1 << 31) + 1, 1 << 30, -(1 << 30)])) % (1 << 32)
            size, number = rng.choice([1, 100, 1400]), i * 7 + len(name)
            rows.append(("s", "c1" if i < 500 else "c2", number, name, "z", 6, 1, 2, 0, seq, size))
            end = (seq + size) % (1 << 32)
            again = furthest is not None and (furthest - end) % (1 << 32) < 1 << 31
            expected[name, number] = int(again)
            furthest = furthest if again else end
    rows += [("s", "c1", 1, "u", "z", 17, 1, 2, 0, 5, 5), ("s", "c1", 2, "u", "z", 6, 1, 2, 0, None, 0)]
    df = spark.createDataFrame(rows, "split string, capture string, frame_no bigint, src_ip string, dst_ip string, protocol int, src_port int, dst_port int, frag_off int, seq bigint, payload_len int")
    from tidewatch.operators.packets import with_retransmissions
    for parts in ("4", "16"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = with_retransmissions(df.repartition(5)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(got) == len(rows) and got[0].__fields__ == [*df.columns, "retrans"]
        assert {(r.src_ip, r.frame_no): r.retrans for r in got if r.src_ip != "u"} == expected
        assert all(r.retrans == 0 for r in got if r.src_ip == "u")
    assert with_retransmissions(df.limit(0)).count() == 0
