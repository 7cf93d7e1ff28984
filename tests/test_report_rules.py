"""Rules that a small table hides: pages beyond the first, first rows per file, text keys, kept frames, unlike headers."""

import struct

import pytest
from pyspark.sql import functions as F
from test_packets_sources import A, B, _full_csv, ether, pcap, tcp, udp

from tidewatch.operators import episodes, models, reports
from tidewatch.operators import packets as pk
from tidewatch.schema import BASE_FEATURES, HAS_PCAP, select_features
from tidewatch.sources import captures, flowlogs, tables


def test_no_window_is_left_out_of_the_documents(spark):
    states = spark.range(6000).select(F.lit("d").alias("split"), F.col("id").alias("w"), F.lit(0.5).alias("score"))
    assert reports.timeline(states).count() == 6000
    assert reports.timeline(states, 10, 5999).count() == 5990
    source = states.groupBy("split").agg(F.count("*").alias("windows")).union(spark.createDataFrame([("empty", 0)], "split string, windows bigint"))
    alarms = spark.createDataFrame([("d", 4, 9), ("d", 5500, 5501)], "split string, begin_w bigint, end_w bigint")
    leads = spark.createDataFrame([("d", 1)], "split string, n bigint")
    docs = reports.payload(source, reports.timeline(states), alarms, leads, F.lit("s"))
    found = F.from_json("payload", "timeline array<struct<w: bigint>>, alarms array<struct<begin_w: bigint>>")
    rows = {(r["split"], r["page"]): r["x"] for r in docs.select("split", "page", found.alias("x")).collect()}
    assert sorted(rows) == [("d", 0), ("d", 1), ("empty", 0)]
    assert sorted(w["w"] for page in (0, 1) for w in rows["d", page]["timeline"]) == list(range(6000))
    assert [a["begin_w"] for a in rows["d", 1]["alarms"]] == [5500]


def test_rows_are_counted_per_file(spark, tmp_path):
    base = {"Src IP": "172.31.0.1", "Dst IP": "8.8.8.8", "Label": "BENIGN"}
    for day in ("one", "two"):
        _full_csv(tmp_path / f"{day}.csv", [base | {"Timestamp": f"2018-02-23 10:00:0{i}", "Src Port": str(i)} for i in range(5)])
    got = flowlogs.read_day_logs(spark, str(tmp_path), ("172.31.",), rows=2).select("split", "src_port").collect()
    assert sorted((r["split"], r["src_port"]) for r in got) == [("one", 0), ("one", 1), ("two", 0), ("two", 1)]


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Src IP,Dst IP,Dst Port\n2018-02-23 10:00:00,1.1.1.1,2.2.2.2,80\n")
    (tmp_path / "b.csv").write_text("Timestamp,Dst IP,Src IP,Dst Port\n2018-02-23 10:00:00,2.2.2.2,1.1.1.1,80\n")
    with pytest.raises(Exception):
        flowlogs.read_flow_log(spark, str(tmp_path), "d", ("1.",)).collect()


def test_partition_keys_stay_text(spark, tmp_path):
    states = spark.createDataFrame([("01", 0, 1.0), ("1", 0, 2.0), ("b", 1, 3.0)], "split string, w bigint, x double")
    tables.write_states(states, str(tmp_path))
    assert [r["x"] for r in tables.read_states(spark, str(tmp_path), ["01"]).collect()] == [1.0]
    assert sorted(r["split"] for r in tables.read_states(spark, str(tmp_path)).collect()) == ["01", "1", "b"]


def test_duplicates_are_looked_for_among_kept_packets(spark):
    # 60 others, of which 20 are copies: the last copy of "x" lies 80 frames on, yet 61 kept packets
    digests = ["x", *(d for i in range(60) for d in ([f"d{i}", f"d{i}"] if i < 20 else [f"d{i}"])), None, "x"]
    rows = [("s", "c", i, i, d, d is None) for i, d in enumerate(digests)]
    packets = spark.createDataFrame(rows, "split string, capture string, frame_no bigint, ts bigint, ip_digest string, skipped boolean")
    kept = pk.drop_capture_duplicates(packets)
    assert kept.count() == 1 + 60 + 1
    assert kept.where("ip_digest = 'x'").count() == 1
    far = [("s", "c", i, i, d, False) for i, d in enumerate(["x", *(f"d{i}" for i in range(64)), "x"])]
    assert pk.drop_capture_duplicates(spark.createDataFrame(far, packets.schema)).count() == 66


def test_datagram_length_is_the_header_s(spark, tmp_path):
    captures.register(spark)
    packet = bytearray(udp(A, B, 1, 2, b"abcd"))
    packet[24:26] = struct.pack("!H", 1008)  # first fragment of a longer datagram
    pcap(tmp_path / "u.pcap", [(1, ether(bytes(packet))), (2, ether(udp(A, B, 1, 2, b"abcd"))), (3, ether(tcp(A, B, 1, 2, payload=b"xy")))])
    rows = spark.read.format("capture").load(str(tmp_path / "u.pcap")).orderBy("frame_no").collect()
    assert [r["payload_len"] for r in rows] == [1000, 4, 2]


def test_absent_blocks_are_ignored_and_partial_ones_refused():
    assert select_features(BASE_FEATURES, ["trend", HAS_PCAP]) == list(BASE_FEATURES)
    assert select_features([*BASE_FEATURES, HAS_PCAP], [HAS_PCAP]) == list(BASE_FEATURES)
    with pytest.raises(ValueError, match="partly"):
        select_features(BASE_FEATURES[:3], ["volume", "rates", "stats"])


def test_a_capture_too_short_to_rotate_counts_in_fisher(spark):
    p = spark.createDataFrame([("a", 0.02, 100), ("b", 1.0, 0)], "split string, p_value double, n_shifts bigint")
    both, one = episodes.fisher_combine(p).first(), episodes.fisher_combine(p.where("n_shifts > 0")).first()
    assert both["df"] == 4 and one["df"] == 2 and both["p_combined"] > one["p_combined"]


def test_leave_one_out_has_no_limit(spark):
    folds = models.leave_one_out(spark.range(1200).select(F.format_string("s%04d", F.col("id")).alias("split")))
    assert len(folds) == 1200 and folds["s0007"] == ["s0007"]
