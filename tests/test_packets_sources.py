"""Packet rules, the capture reader, text sources and sinks."""

import json
import struct
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from tidewatch import Grid
from tidewatch.operators import flows as assembly
from tidewatch.operators import packets as pk
from tidewatch.plans import build
from tidewatch.sources import captures, dimensions, flowlogs, tables

A, B = "192.168.10.5", "8.8.8.8"
SYN, ACK, FIN, RST = 2, 16, 1, 4


def tcp(src, dst, sport, dport, flags=ACK, seq=0, win=8192, payload=b"", ttl=64, frag=0, ident=1):
    seg = struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 5 << 4, flags, win, 0, 0) + payload
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), ident, frag, ttl, 6, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return head + seg


def udp(src, dst, sport, dport, payload=b"x"):
    seg = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), 1, 0, 64, 17, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return head + seg


def pcap(path, frames, order="<", nano=False, link=1):
    magic = (0xA1B23C4D if nano else 0xA1B2C3D4)
    with open(path, "wb") as fh:
        fh.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link))
        for seconds, frame in frames:
            whole = int(seconds)
            part = round((seconds - whole) * (1e9 if nano else 1e6))
            fh.write(struct.pack(order + "IIII", whole, part, len(frame), len(frame)) + frame)


def pcapng(path, frames, order="<", resolution=None):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = 12 + len(body)
        return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)

    option = struct.pack(order + "HHB3x", 9, 1, resolution) + struct.pack(order + "HH", 0, 0) if resolution is not None else b""
    with open(path, "wb") as fh:
        fh.write(block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)))
        fh.write(block(1, struct.pack(order + "HHI", 1, 0, 65535) + option))
        for seconds, frame in frames:
            ticks = round(seconds * 10 ** (6 if resolution is None else resolution))
            fh.write(block(6, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame))


def ether(packet, vlan=False):
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + packet


@pytest.fixture(scope="module")
def reader(spark):
    captures.register(spark)
    return lambda path, **opts: spark.read.format("capture").options(**opts).load(str(path))


def test_capture_formats_agree(reader, tmp_path):
    frames = [(1.5, ether(tcp(A, B, 4000, 80, SYN))), (2.25, ether(udp(A, B, 53, 53, b"abc"), vlan=True)), (3.0, b"\0" * 12 + b"\x08\x06" + b"\0" * 30)]
    pcap(tmp_path / "le.pcap", frames)
    pcap(tmp_path / "be.pcap", frames, ">", nano=True)
    pcapng(tmp_path / "ng.pcapng", frames)
    pcapng(tmp_path / "ngbe.pcapng", frames, ">", 9)
    rows = reader(tmp_path).orderBy("split", "frame_no").collect()
    assert len(rows) == 12
    by_file = {}
    for r in rows:
        by_file.setdefault(r["split"], []).append((r["frame_no"], r["ts"].timestamp(), r["src_port"], r["dst_port"], r["payload_len"], r["tcp_flags"], r["hdr_len"], r["skipped"]))
    assert len(set(map(tuple, by_file.values()))) == 1
    first = by_file["le"]
    assert first[0][2:] == (4000, 80, 0, SYN, 20, False) and first[1][2:] == (53, 53, 3, 0, 8, False) and first[2][-1] is True
    assert first[1][1] - first[0][1] == pytest.approx(0.75)


def test_capture_raw_link_and_bad_file(reader, tmp_path):
    pcap(tmp_path / "raw.pcap", [(1, udp(A, B, 1, 2))], link=101)
    assert reader(tmp_path / "raw.pcap").first()["src_ip"] == A
    (tmp_path / "bad.pcap").write_bytes(b"not a capture at all")
    with pytest.raises(Exception, match="neither pcap nor pcapng"):
        reader(tmp_path / "bad.pcap").collect()


def test_reader_drops_exact_duplicates(reader, tmp_path):
    one = ether(tcp(A, B, 1, 2, payload=b"a"))
    other = [ether(tcp(A, B, 1, 2, payload=b"b", ident=i)) for i in range(70)]
    pcap(tmp_path / "d.pcap", [(1, one), (1.1, one), *((2 + i, f) for i, f in enumerate(other)), (99, one)])
    assert reader(tmp_path / "d.pcap").count() == 73
    assert reader(tmp_path / "d.pcap", dedupe=64).count() == 72
    # the column form agrees: the copy 72 frames on is not a duplicate, the adjacent one is
    assert pk.drop_capture_duplicates(reader(tmp_path / "d.pcap")).count() == 72


def _flows(reader, tmp_path, frames):
    pcap(tmp_path / "f.pcap", [(t, ether(p)) for t, p in frames])
    return assembly.assemble_flows(reader(tmp_path / "f.pcap")).orderBy("ts").collect()


def test_teardown_then_reused_tuple(reader, tmp_path):
    def connection(t):
        return [(t, tcp(A, B, 5, 80, SYN)), (t + .1, tcp(B, A, 80, 5, SYN | ACK)), (t + .2, tcp(A, B, 5, 80)), (t + .3, tcp(A, B, 5, 80, FIN | ACK)),
                (t + .4, tcp(B, A, 80, 5, FIN | ACK)), (t + .5, tcp(A, B, 5, 80))]
    rows = _flows(reader, tmp_path, connection(10) + connection(11))
    assert [(r["src_ip"], r["fwd_pkts"], r["bwd_pkts"], r["fin_cnt"]) for r in rows] == [(A, 4, 2, 2), (A, 4, 2, 2)]


def test_refused_then_retried(reader, tmp_path):
    rows = _flows(reader, tmp_path, [(1, tcp(A, B, 5, 80, SYN)), (1.1, tcp(B, A, 80, 5, RST | ACK)), (1.2, tcp(B, A, 80, 5, RST)),
                                     (2, tcp(A, B, 5, 80, SYN)), (2.1, tcp(B, A, 80, 5, RST | ACK))])
    assert [r["rst_cnt"] for r in rows] == [2, 1] and [r["bwd_rst_cnt"] for r in rows] == [2, 1]


def test_timeout_runs_from_the_first_packet_and_keeps_direction(reader, tmp_path):
    frames = [(t, udp(A, B, 5, 53) if t % 20 else udp(B, A, 53, 5)) for t in range(10, 400, 10)]
    rows = _flows(reader, tmp_path, frames)
    assert [int(r["ts"].timestamp()) for r in rows] == [10, 140, 270] and {r["src_ip"] for r in rows} == {A}
    # a long pause splits the tuple into independent runs; a continuation that opens with a reply keeps the direction
    rows = _flows(reader, tmp_path, [(1, udp(A, B, 5, 53)), (2, udp(B, A, 53, 5)), (500, udp(B, A, 53, 5)), (501, udp(A, B, 5, 53))])
    assert [(r["src_ip"], r["fwd_pkts"]) for r in rows] == [(A, 1), (A, 1)]


def test_idle_gap_flow(reader, tmp_path):
    rows = _flows(reader, tmp_path, [(0.0, tcp(A, B, 5, 80, win=8192, payload=b"x" * 10)), (0.1, tcp(B, A, 80, 5, win=300)), (10.0, tcp(A, B, 5, 80, win=9, payload=b"y")),
                                     (10.05, tcp(B, A, 80, 5, win=301)), (10.1, tcp(A, B, 5, 80, win=10))])
    r = rows[0]
    assert (r["active_mean"], r["idle_mean"], r["fwd_data_pkts"]) == (100_000, 9_900_000, 1)
    assert (r["fwd_init_win"], r["bwd_init_win"], r["fwd_seg_size_min"], r["fwd_hdr_bytes"]) == (8192, 301, 20, 60)
    assert r["duration_us"] == 10_100_000 and r["flow_iat_max"] == 9_900_000


def test_single_packets_and_later_fragments_are_left_out(reader, tmp_path):
    assert _flows(reader, tmp_path, [(1, udp(A, B, 5, 53)), (2, tcp(A, B, 6, 80, frag=0x0010))]) == []


def test_retransmission_wraps(spark):
    seqs = [(4294967290, 4), (2, 4), (4294967290, 4), (2, 4), (6, 4)]  # the counter passes 2^32 once
    rows = [("d", "c", i, A, B, 6, 1, 2, 0, s, n) for i, (s, n) in enumerate(seqs)]
    df = spark.createDataFrame(rows, "split string, capture string, frame_no bigint, src_ip string, dst_ip string, protocol int, src_port int, dst_port int, frag_off int, seq bigint, payload_len int")
    out = pk.with_retransmissions(df).orderBy("frame_no").collect()
    assert [r["retrans"] for r in out] == [0, 0, 1, 1, 0]


def test_states_from_a_capture(reader, tmp_path):
    frames = []
    for i in range(40):
        frames += [(i * 3.0, ether(tcp(A, B, 5000 + i, 80, SYN, seq=1, payload=b"", ident=2 * i))), (i * 3.0 + 1, ether(tcp(B, A, 80, 5000 + i, SYN | ACK, ident=2 * i + 1)))]
    pcap(tmp_path / "s.pcap", frames)
    states, grid = build.states_from_packets(reader(tmp_path / "s.pcap"), ("192.168.10.",))
    rows = states.orderBy("w").collect()
    assert rows[0]["n_flows"] == 20 and rows[0]["pcap_pkts"] == 40 and rows[0]["has_pcap"] == 1 and rows[0]["pcap_syn_only_rate"] == 0.5
    assert rows[0]["is_outbound_rate"] == 1


# ---- text sources ----------------------------------------------------------------------------------------

def test_flow_log_is_tolerant(spark, tmp_path):
    (tmp_path / "log.csv").write_text("Flow ID, Timestamp, Src IP , Dst IP,Dst Port,Total Fwd Packet,Label,Flow IAT Mean\n"
                                      "a,2017-07-04 12:00:00.250000,192.168.10.5,8.8.8.8,80,3,BENIGN,NaN\nb,garbage,1.1.1.1,8.8.8.8,80,3,BENIGN,1\n"
                                      "c,14/02/2018 08:31:01,1.1.1.1,192.168.10.5,22.0,,SSH-Patator - Attempted,2\n")
    rows = {r["src_ip"]: r for r in flowlogs.read_flow_log(spark, str(tmp_path / "log.csv"), "up", ("192.168.10.",)).collect()}
    assert len(rows) == 2 and rows["192.168.10.5"]["fwd_pkts"] == 3 and rows["192.168.10.5"]["syn_cnt"] == 0
    assert rows["192.168.10.5"]["flow_iat_mean"] is None and rows["1.1.1.1"]["dst_port"] == 22
    assert rows["1.1.1.1"]["stage"] == 2 and rows["1.1.1.1"]["attempted"]
    (tmp_path / "short.csv").write_text("Src IP,Label\n1.1.1.1,BENIGN\n")
    with pytest.raises(ValueError, match="Timestamp"):
        flowlogs.read_flow_log(spark, str(tmp_path / "short.csv"), "up", ())


def _full_csv(path, rows):
    names = list(flowlogs.HEADER)
    with open(path, "w") as fh:
        fh.write(",".join(names) + "\n")
        for row in rows:
            fh.write(",".join(str(row.get(n, 0)) for n in names) + "\n")


def test_dated_logs_set_rows_aside(spark, tmp_path):
    base = {"Src IP": "172.31.0.1", "Dst IP": "8.8.8.8", "Label": "BENIGN"}
    _full_csv(tmp_path / "Friday-23-02-2018.csv", [base | {"Timestamp": "2018-02-23 10:00:00"}, base | {"Timestamp": "2018-02-21 10:00:00"},
                                                   base | {"Timestamp": "2018-02-23 11:00:00", "Label": "-1"}])
    flows, dropped = flowlogs.read_dated_logs(spark, str(tmp_path), ("172.31.",))
    assert flows.count() == 1 and flows.first()["split"] == "23-02-2018"
    assert {r["reason"]: r["flows"] for r in dropped.collect()} == {"before_capture_date": 1, "label_-1": 1}
    day = flowlogs.read_day_logs(spark, str(tmp_path), ("172.31.",), rows=1)
    assert day.count() == 1 and day.first()["split"] == "Friday-23-02-2018"


def test_biflow_source(spark, tmp_path):
    (tmp_path / "scenario01.binetflow").write_text(
        "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"
        "2011/08/10 09:46:59.607825,1.026539,tcp,94.44.127.113,1577,   ->,147.32.84.59,6881,S_RA,0,0,4,276,156,flow=Background-Established-cmpgw-CVUT\n"
        "2011/08/10 09:47:00,0.5,udp,147.32.84.165,0x0303,   ->,8.8.8.8,,INT,0,0,3,300,300,flow=From-Botnet-V42-UDP-Attempt\n")
    a, b = flowlogs.read_biflow(spark, str(tmp_path)).orderBy("ts").collect()
    assert (a["split"], a["fwd_pkts"], a["bwd_pkts"], a["bwd_bytes"], a["syn_cnt"], a["rst_cnt"], a["stage"]) == ("scenario01", 2, 2, 120, 1, 1, 0)
    assert (b["src_port"], b["dst_port"], b["fwd_pkts"], b["bwd_pkts"], b["syn_cnt"], b["stage"]) == (771, 0, 3, 0, 0, 1)


def test_time_slice_reaches_the_scan(spark, make_flows, tmp_path):
    make_flows([{"at": i} for i in range(10)]).write.parquet(str(tmp_path / "f"))
    df = flowlogs.time_slice(spark.read.parquet(str(tmp_path / "f")), F.lit(T0 + timedelta(seconds=2)), F.lit(T0 + timedelta(seconds=5)))
    assert df.count() == 3
    assert "GreaterThanOrEqual(ts" in df._jdf.queryExecution().executedPlan().toString()


def test_state_sink_prunes_splits(spark, tmp_path):
    states = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("b", 1, 3.0)], "split string, w bigint, x double")
    tables.write_states(states, str(tmp_path), states.groupBy("split").count())
    got = tables.read_states(spark, str(tmp_path), ["b"])
    assert got.count() == 2 and tables.read_meta(spark, str(tmp_path)).count() == 2
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    assert len(got.inputFiles()) >= 1


def test_hourly_staging(spark, make_flows, tmp_path):
    flows = make_flows([{"at": h * 3600 + i} for h in range(4) for i in range(5)])
    tables.write_hourly(flows, str(tmp_path / "h"))
    got = tables.read_hours(spark, str(tmp_path / "h"), "2024010101", "2024010102")
    assert got.count() == 10 and set(got.columns) == set(flows.columns)


def test_score_store(spark, tmp_path):
    (tmp_path / "exp-s43").mkdir()
    doc = {"metrics": {"per_day": {"mon": {"scores": [0.1, 0.2], "threat_scores": [0.3, 0.4]}}}}
    (tmp_path / "exp-s43" / "metrics.json").write_text(json.dumps(doc))
    rows = tables.read_score_store(spark, str(tmp_path / "*" / "metrics.json")).collect()
    assert {(r["run"], r["seed"], r["split"], r["w"], r["channel"], r["score"]) for r in rows} == {
        ("exp-s43", 43, "mon", 0, "comp", 0.1), ("exp-s43", 43, "mon", 1, "comp", 0.2), ("exp-s43", 43, "mon", 0, "threat", 0.3), ("exp-s43", 43, "mon", 1, "threat", 0.4)}
    del doc["metrics"]["per_day"]["mon"]["threat_scores"]
    (tmp_path / "exp-s43" / "metrics.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="no threat scores"):
        tables.read_score_store(spark, str(tmp_path / "*" / "metrics.json")).collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_table_sink(spark, tmp_path, fmt):
    tables.write_table(spark.range(3), str(tmp_path / "t"), fmt)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    assert reader.format(fmt).load(str(tmp_path / "t")).count() == 3


def test_dimensions(spark):
    assert dimensions.stage_catalogue(spark).count() == 7 and dimensions.scenario_families(spark).count() == 13
    assert dimensions.attack_schedule(spark).where("end > start").count() == 17 and dimensions.service_ports(spark).count() == 19
