"""Column names, feature blocks and Spark schemas: the frozen contract between operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: canonical flow columns, in order -----------------------------------------------------
FLOW_FIELDS: tuple[tuple[str, T.DataType], ...] = (
    ("ts", T.TimestampType()), ("src_ip", T.StringType()), ("src_port", T.IntegerType()),
    ("dst_ip", T.StringType()), ("dst_port", T.IntegerType()), ("protocol", T.IntegerType()),
    ("duration_us", T.DoubleType()), ("fwd_pkts", T.LongType()), ("bwd_pkts", T.LongType()),
    ("fwd_bytes", T.LongType()), ("bwd_bytes", T.LongType()), ("flow_iat_mean", T.DoubleType()),
    ("flow_iat_std", T.DoubleType()), ("flow_iat_max", T.DoubleType()), ("flow_iat_min", T.DoubleType()),
    ("fin_cnt", T.LongType()), ("syn_cnt", T.LongType()), ("rst_cnt", T.LongType()),
    ("psh_cnt", T.LongType()), ("ack_cnt", T.LongType()), ("urg_cnt", T.LongType()),
    ("cwr_cnt", T.LongType()), ("ece_cnt", T.LongType()), ("pkt_len_min", T.DoubleType()),
    ("pkt_len_max", T.DoubleType()), ("pkt_len_mean", T.DoubleType()), ("pkt_len_std", T.DoubleType()),
    ("down_up_ratio", T.DoubleType()), ("fwd_init_win", T.LongType()), ("bwd_init_win", T.LongType()),
    ("fwd_seg_size_min", T.LongType()), ("active_mean", T.DoubleType()), ("idle_mean", T.DoubleType()),
    ("label", T.StringType()), ("attempted", T.BooleanType()), ("stage", T.IntegerType()),
)
FLOW_COLUMNS = tuple(name for name, _ in FLOW_FIELDS)
FLOW_TYPES = dict(FLOW_FIELDS)

#: optional per-direction packet statistics of a flow; an absent column counts as 0
PACKET_STAT_FIELDS: tuple[tuple[str, T.DataType], ...] = (
    ("fwd_pkt_len_std", T.DoubleType()), ("bwd_pkt_len_std", T.DoubleType()),
    ("fwd_iat_std", T.DoubleType()), ("bwd_iat_std", T.DoubleType()),
    ("fwd_rst_cnt", T.LongType()), ("bwd_rst_cnt", T.LongType()),
    ("fwd_hdr_bytes", T.LongType()), ("fwd_data_pkts", T.LongType()),
)
PACKET_STAT_COLUMNS = tuple(name for name, _ in PACKET_STAT_FIELDS)

PACKET_SCHEMA = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("capture", T.StringType()),
    T.StructField("frame_no", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
    T.StructField("protocol", T.IntegerType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("ttl", T.IntegerType()),
    T.StructField("more_frags", T.BooleanType()), T.StructField("frag_off", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()), T.StructField("seq", T.LongType()),
    T.StructField("tcp_win", T.IntegerType()), T.StructField("hdr_len", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()), T.StructField("ip_digest", T.BinaryType()),
    T.StructField("skipped", T.BooleanType()),
])

# --- fixed values: ordered stages -----------------------------------------------------------------------
STAGES = ("BENIGN", "RECONNAISSANCE", "INITIAL_ACCESS", "LATERAL_MOVEMENT", "COMMAND_AND_CONTROL",
          "EXFILTRATION", "IMPACT")
STAGE_TITLES = ("Benign", "Reconnaissance", "Initial Access", "Lateral Movement", "Command & Control",
                "Exfiltration", "Impact")
STAGE_TACTICS = ("", "TA0043", "TA0001", "TA0008", "TA0011", "TA0010", "TA0040")
IMPACT = 6
COMPROMISE_FROM = 3
HORIZON = 10

# --- fixed values: service ports ------------------------------------------------------------------------
SERVICE_PORTS: dict[str, tuple[int, ...]] = {
    "http": (80, 8080, 8000), "https": (443, 8443), "dns": (53,), "ssh": (22,), "ftp": (20, 21),
    "smtp": (25, 465, 587), "smb": (139, 445), "rdp": (3389,), "db": (1433, 3306, 5432, 1521),
}

# --- fixed values: feature names, in order --------------------------------------------------------------
VOLUME = ("n_flows", "flows_per_s", "bytes_total", "bytes_per_s", "pkts_total", "pkts_per_s")
RATE_BASES = ("syn_no_ack", "has_rst", "has_fin", "one_way", "tiny_flow", "priv_port", "ephemeral_dst",
              "is_outbound", "is_inbound", "is_internal", "proto_tcp", "proto_udp", "proto_icmp",
              *(f"svc_{name}" for name in SERVICE_PORTS))
RATES = tuple(f"{base}_rate" for base in RATE_BASES)
STATISTICS: tuple[tuple[str, str], ...] = (
    ("duration_s", "mean"), ("duration_s", "max"), ("bytes", "mean"), ("bytes", "max"), ("pkts", "mean"),
    ("pkt_len_mean", "mean"), ("pkt_len_max", "max"), ("pkt_len_std", "mean"), ("flow_iat_mean", "mean"),
    ("flow_iat_std", "mean"), ("flow_iat_max", "max"), ("flow_iat_min", "min"), ("down_up_ratio", "mean"),
    ("fwd_init_win", "mean"), ("fwd_init_win", "std"), ("bwd_init_win", "mean"), ("fwd_seg_size_min", "mean"),
    ("active_mean", "mean"), ("idle_mean", "mean"), ("syn_cnt", "sum"), ("ack_cnt", "sum"), ("fin_cnt", "sum"),
    ("rst_cnt", "sum"), ("psh_cnt", "sum"), ("urg_cnt", "sum"),
)
STATS = tuple(f"{col}_{how}" for col, how in STATISTICS)
SPREAD = ("uniq_src_ip", "uniq_dst_ip", "uniq_dst_port", "uniq_src_port", "dst_port_entropy", "dst_ip_entropy",
          "src_ip_entropy", "fanout_max", "fanout_mean", "port_fanout_max", "top_talker_share",
          "seq_port_ratio", "ports_per_pair_max")
DIRECTION = ("outbound_bytes", "inbound_bytes", "byte_asymmetry")
BASE_FEATURES = (*VOLUME, *RATES, *STATS, *SPREAD, *DIRECTION, "beacon_score")

TREND_BASES = ("uniq_dst_port", "ports_per_pair_max", "port_fanout_max", "uniq_dst_ip", "fanout_mean", "flows_per_s")
TREND_SLOPES = (5, 10)
TREND_FEATURES = tuple(f"{base}_{kind}" for base in TREND_BASES
                       for kind in ("delta", *(f"slope_{n}" for n in TREND_SLOPES), "zscore"))
BASELINE_WINDOWS = 120
BASELINE_MIN = 10
Z_CLIP = 10.0

HOST_SLOT_FEATURES = ("fanout", "ports", "byte_asym", "new_peer_rate")


def host_slot_names(slots: int) -> tuple[str, ...]:
    return tuple(f"host{i}_{name}" for i in range(1, slots + 1) for name in HOST_SLOT_FEATURES)


PAYLOAD_BINS = ("payload_0_rate", "payload_1_64_rate", "payload_65_512_rate", "payload_513_1024_rate",
                "payload_gt1024_rate")
FLOW_PACKET_FEATURES = (
    "pkt_win_zero_rate", "pkt_win_small_rate", "pkt_win_distinct", "pkt_win_entropy",
    *(f"pkt_{name}" for name in PAYLOAD_BINS),
    "pkt_fwd_len_std_mean", "pkt_bwd_len_std_mean", "pkt_fwd_iat_std_mean", "pkt_bwd_iat_std_mean",
    "pkt_iat_cv_median", "pkt_bwd_rst_rate", "pkt_syn_probe_rate", "pkt_fwd_hdr_per_pkt_mean",
)
HOST_RELATIVE_FEATURES = ("hostrel_ports_z_max", "hostrel_fanout_z_max", "hostrel_flows_ratio_max",
                          "hostrel_new_peer_hosts", "hostrel_new_ports_max", "hostrel_new_hosts")
PCAP_FEATURES = (
    "pcap_pkts", "pcap_ttl_mean", "pcap_ttl_std", "pcap_ttl_distinct", "pcap_ttl_low_rate", "pcap_frag_rate",
    "pcap_retrans_rate", "pcap_zero_win_rate", "pcap_win_std", *(f"pcap_{name}" for name in PAYLOAD_BINS),
    "pcap_iat_std", "pcap_iat_cv", "pcap_syn_only_rate", "pcap_rst_rate",
)
HAS_PCAP = "has_pcap"
#: base features a bi-flow source cannot measure (its columns are 0), to be left out of a model's inputs
NOT_IN_BIFLOW = (
    "pkt_len_mean_mean", "pkt_len_max_max", "pkt_len_std_mean", "flow_iat_mean_mean", "flow_iat_std_mean",
    "flow_iat_max_max", "flow_iat_min_min", "down_up_ratio_mean", "fwd_init_win_mean", "fwd_init_win_std",
    "bwd_init_win_mean", "fwd_seg_size_min_mean", "active_mean_mean", "idle_mean_mean",
)
FEATURE_BLOCKS: dict[str, tuple[str, ...]] = {
    "volume": VOLUME, "rates": RATES, "stats": STATS, "spread": SPREAD, "direction": DIRECTION,
    "beacon": ("beacon_score",), "trend": TREND_FEATURES, "flow_packets": FLOW_PACKET_FEATURES,
    "host_relative": HOST_RELATIVE_FEATURES, "pcap": (*PCAP_FEATURES, HAS_PCAP), HAS_PCAP: (HAS_PCAP,), "not_in_biflow": NOT_IN_BIFLOW,
}


def target_names(horizon: int = HORIZON) -> tuple[str, ...]:
    steps = range(1, horizon + 1)
    return ("stage", *(f"stage_{name}" for name in STAGES), "compromise", *(f"hazard_k{k}" for k in steps),
            "y_within_K", "attack_now", "y_attack_within_K", "escalate_step", "y_escalate_within_K",
            *(f"{kind}_k{k}" for k in steps for kind in ("attack", "escalate")))


def validate_flows(df: DataFrame) -> DataFrame:
    """Every canonical column present with its type; a schema check, so no job runs."""
    have = dict(df.dtypes)
    missing = [name for name in ("split", *FLOW_COLUMNS) if name not in have]
    if missing:
        raise ValueError(f"flows lack canonical columns {missing}")
    wrong = [f"{name}: {have[name]}" for name, kind in FLOW_FIELDS if have[name] != kind.simpleString()]
    if wrong:
        raise ValueError(f"flows have wrong column types: {wrong}")
    return df


def select_features(names, drop=()) -> list[str]:
    """Drop whole blocks by name. A block that is not there at all is ignored; an unknown block, or one only partly
    present, is an error."""
    names, gone = list(names), set()
    for block in drop:
        if block not in FEATURE_BLOCKS:
            raise ValueError(f"unknown feature block {block!r}; known: {sorted(FEATURE_BLOCKS)}")
        present = set(FEATURE_BLOCKS[block]) & set(names)
        if present and present != set(FEATURE_BLOCKS[block]):
            raise ValueError(f"block {block!r} is only partly present: {len(present)} of {len(FEATURE_BLOCKS[block])}")
        gone |= present
    return [name for name in names if name not in gone]
