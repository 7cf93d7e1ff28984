import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions.columns import parse_port
from tidewatch.operators import targets

CASES = [("BENIGN", 0), ("DoS Hulk", 6), ("DDoS", 6), ("Portscan", 1), ("FTP-Patator", 2), ("SSH-Patator - Attempted", 2),
         ("Web Attack � Brute Force", 2), ("Web Attack - XSS", 2), ("Infiltration", 3), ("Infiltration - Portscan", 3),
         ("Infiltration - NMAP Portscan", 3), ("Infiltration - Communication Victim Attacker", 4), ("Botnet ARES", 4), ("Heartbleed", 2),
         ("Data Exfiltration", 5)]


def test_every_spelling_maps(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "label string")
    got = {r["label"]: r["m"] for r in df.select("label", labels.map_label(F.col("label")).alias("m")).collect()}
    for label, stage in CASES:
        assert got[label]["stage"] == stage, label
        assert got[label]["attempted"] == ("Attempted" in label)


@pytest.mark.parametrize("label", ["something new", "", None])
def test_uncovered_label_fails(spark, label):
    df = spark.createDataFrame([(label,)], "label string")
    with pytest.raises(Exception, match="no stage rule"):
        df.select(labels.map_label(F.col("label")).alias("m")).collect()


def test_scan_direction(spark):
    df = spark.createDataFrame([("Infiltration - Portscan", "205.174.165.73", 3), ("Infiltration - Portscan", "192.168.10.8", 3), ("Infiltration", "1.2.3.4", 3)],
                               "label string, src_ip string, stage int")
    got = [r[0] for r in df.select(labels.refine_scan_direction(F.col("label"), F.col("stage"), F.col("src_ip"), ("192.168.10.",))).collect()]
    assert got == [1, 3, 3]


def test_distinct_mapping_falls_back_in_place(spark):
    df = spark.createDataFrame([(f"DoS {i}",) for i in range(20)], "label string")
    few = labels.map_distinct(df, "label", labels.normalise_label(F.col("label")), "n").collect()
    many = labels.map_distinct(df, "label", labels.normalise_label(F.col("label")), "n", limit=5).collect()
    assert sorted(few) == sorted(many)


def test_ports(spark):
    df = spark.createDataFrame([("80",), ("0x0303",), ("",), (None,), ("abc",), ("0o17",), ("0b11",), ("007",), ("0",)], "p string")
    assert [r[0] for r in df.select(parse_port(F.col("p"))).collect()] == [80, 771, 0, 0, 0, 15, 3, 0, 0]


def test_hazard_looks_forward(make_stages):
    out = targets.with_targets(make_stages([0, 0, 3, 3, 0]), horizon=2).orderBy("w").collect()
    assert [[r["hazard_k1"], r["hazard_k2"]] for r in out] == [[0, 1], [1, 1], [1, 0], [0, 0], [0, 0]]
    assert [r["y_within_K"] for r in out] == [1, 1, 1, 0, 0]


def test_impact_is_not_compromise_and_not_progress(make_stages):
    out = targets.with_targets(make_stages([0, 6, 1, 3]), horizon=2).orderBy("w").collect()
    assert [r["compromise"] for r in out] == [0, 0, 0, 1] and [r["attack_now"] for r in out] == [0, 1, 1, 1]
    assert [r["escalate_step"] for r in out] == [0, 0, 1, 1] and out[0]["escalate_k1"] == 0 and out[0]["escalate_k2"] == 1


def test_onset_gap(make_stages):
    s = make_stages([3, 3, 0, 0, 0, 0, 0, 3])
    assert [r["onset_w"] for r in targets.episode_onsets(s, "compromise").orderBy("onset_w").collect()] == [0, 7]
    s = make_stages([0] * 6 + [2, 2, 2] + [0] * 5 + [6, 6, 0, 0])
    got = [(r["onset_w"], r["family"]) for r in targets.episode_onsets(s).orderBy("onset_w").collect()]
    assert got == [(6, "INITIAL_ACCESS"), (14, "IMPACT")]
    assert [r["onset_w"] for r in targets.episode_onsets(s, gap=10).collect()] == [6]
    flags = targets.episode_labels(s, horizon=4).orderBy("w").collect()
    assert [r["w"] for r in flags if r["precursor"]] == [2, 3, 4, 5, 10, 11, 12, 13]
    assert [r["w"] for r in flags if r["onset_now"]] == [6, 14]
    with pytest.raises(ValueError):
        targets.episode_onsets(s, "nothing")


def test_quiet_before(make_stages):
    s = make_stages([0] * 6 + [2, 2, 2] + [0] * 5 + [6, 6, 0, 0])
    rows = targets.quiet_before(s, targets.episode_onsets(s)).orderBy("onset_w").collect()
    assert [r["quiet_windows"] for r in rows] == [6, 5]


def test_targets_never_cross_a_split(make_stages):
    both = make_stages([0, 0, 0], "a").unionByName(make_stages([3, 3, 3], "b"))
    out = targets.with_targets(both, 3).where("split = 'a'").agg(F.sum("y_within_K")).first()[0]
    assert out == 0
