"""Flow-log sources: flow-meter CSV, day files with quarantine, bi-flow CSV; time slices.

A reader is ``spark.read.csv`` with every column as text (so unread columns are pruned at the scan) followed by
a pure column mapping, which can also be applied to text columns from anywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import biflow_packets, biflow_replied, clean, flag_sides, parse_port
from tidewatch.functions.labels import biflow_stage, with_stages
from tidewatch.schema import FLOW_COLUMNS, FLOW_TYPES, PACKET_STAT_COLUMNS, PACKET_STAT_FIELDS, validate_flows

# --- fixed values: flow-meter CSV header -> canonical column ---------------------------------------------
HEADER: dict[str, str] = {
    "Timestamp": "ts", "Src IP": "src_ip", "Src Port": "src_port", "Dst IP": "dst_ip", "Dst Port": "dst_port",
    "Protocol": "protocol", "Flow Duration": "duration_us", "Total Fwd Packet": "fwd_pkts",
    "Total Bwd packets": "bwd_pkts", "Total Length of Fwd Packet": "fwd_bytes",
    "Total Length of Bwd Packet": "bwd_bytes", "Flow IAT Mean": "flow_iat_mean", "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max", "Flow IAT Min": "flow_iat_min", "FIN Flag Count": "fin_cnt",
    "SYN Flag Count": "syn_cnt", "RST Flag Count": "rst_cnt", "PSH Flag Count": "psh_cnt",
    "ACK Flag Count": "ack_cnt", "URG Flag Count": "urg_cnt", "CWR Flag Count": "cwr_cnt",
    "ECE Flag Count": "ece_cnt", "Packet Length Min": "pkt_len_min", "Packet Length Max": "pkt_len_max",
    "Packet Length Mean": "pkt_len_mean", "Packet Length Std": "pkt_len_std", "Down/Up Ratio": "down_up_ratio",
    "FWD Init Win Bytes": "fwd_init_win", "Bwd Init Win Bytes": "bwd_init_win",
    "Fwd Seg Size Min": "fwd_seg_size_min", "Active Mean": "active_mean", "Idle Mean": "idle_mean", "Label": "label",
}
PACKET_STAT_HEADER: dict[str, str] = {
    "Fwd Packet Length Std": "fwd_pkt_len_std", "Bwd Packet Length Std": "bwd_pkt_len_std",
    "Fwd IAT Std": "fwd_iat_std", "Bwd IAT Std": "bwd_iat_std", "Fwd RST Flags": "fwd_rst_cnt",
    "Bwd RST Flags": "bwd_rst_cnt", "Fwd Header Length": "fwd_hdr_bytes", "Fwd Act Data Pkts": "fwd_data_pkts",
}
REQUIRED = ("Timestamp", "Src IP", "Dst IP", "Dst Port")
#: counters a log may lack; they then count 0
COUNTERS = ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "syn_cnt", "ack_cnt", "rst_cnt", "fin_cnt", "psh_cnt",
            "urg_cnt", "cwr_cnt", "ece_cnt", "duration_us")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "M/d/yyyy H:mm[:ss]", "d/M/yyyy H:mm[:ss]", "d/M/yyyy h:mm:ss a")
UNLABELLED = "-1"
# --- fixed values: bi-flow CSV ---------------------------------------------------------------------------
BIFLOW_HEADER = ("StartTime", "Dur", "Proto", "SrcAddr", "Sport", "DstAddr", "Dport", "State", "TotPkts", "TotBytes",
                 "SrcBytes", "Label")
BIFLOW_TIME = "yyyy/MM/dd HH:mm:ss[.SSSSSS]"
BIFLOW_FLAGS = {"S": "syn_cnt", "A": "ack_cnt", "F": "fin_cnt", "R": "rst_cnt", "P": "psh_cnt", "U": "urg_cnt",
                "E": "ece_cnt", "C": "cwr_cnt"}
BIFLOW_UNRECORDED = ("flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "pkt_len_min", "pkt_len_max",
                     "pkt_len_mean", "pkt_len_std", "down_up_ratio", "fwd_init_win", "bwd_init_win",
                     "fwd_seg_size_min", "active_mean", "idle_mean")


def parse_time(text: Column, formats=TIME_FORMATS) -> Column:
    """The first format that fits; null when none does. ISO text goes through Spark's own parser first."""
    tries = [F.try_to_timestamp(F.trim(text))]
    tries += [F.try_to_timestamp(F.trim(text), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries)


def _typed(text: Column, kind: T.DataType) -> Column:
    """Text to a canonical type; whole numbers may be written as decimals ("3.0"); NaN becomes null."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DoubleType):
        return clean(text.try_cast("double"))
    return F.coalesce(text.try_cast("long"), clean(text.try_cast("double")).cast("long")).cast(kind)


def canonical_flow_log(raw: DataFrame, split: Column, internal: tuple[str, ...], formats=TIME_FORMATS) -> DataFrame:
    """Tolerant mapping of a flow-meter log: header spaces ignored, extra columns dropped, rows without a
    readable time dropped, missing counters 0, label columns only where the log has labels."""
    by_name = {c.strip(): c for c in raw.columns}
    missing = [c for c in REQUIRED if c not in by_name]
    if missing:
        raise ValueError(f"flow log lacks required columns {missing}: it needs times, addresses and a destination port")
    kinds = {**FLOW_TYPES, **dict(PACKET_STAT_FIELDS)}
    cols = {"split": split}
    for header, name in {**HEADER, **PACKET_STAT_HEADER}.items():
        if header not in by_name:
            continue
        source = F.col(f"`{by_name[header]}`")
        cols[name] = parse_time(source, formats) if name == "ts" else _typed(source, kinds[name])
    for name in COUNTERS:
        cols.setdefault(name, F.lit(0).cast(kinds[name]))
    keep = [c for c in raw.columns if c.startswith("_")]
    flows = raw.select(*keep, *(c.alias(n) for n, c in cols.items())).where(F.col("ts").isNotNull())
    return with_stages(flows, internal) if "label" in cols else flows


def _text_csv(spark: SparkSession, path) -> DataFrame:
    # a file whose header is not that of the others is refused: read by position, its columns would be swapped
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("enforceSchema", False).csv(path)


def read_flow_log(spark: SparkSession, path, split: str, internal: tuple[str, ...]) -> DataFrame:
    """One uploaded log, whatever subset of columns it has."""
    return canonical_flow_log(_text_csv(spark, path), F.lit(split), internal)


def read_day_logs(spark: SparkSession, path, internal: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """S3: full day files; the split is the file's name. Every canonical column must be there.

    ``rows`` keeps the first rows of each file, in the file's order.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv(\.gz)?$", "")
    raw = _text_csv(spark, path).withColumns({"_split": F.url_decode(name), "_at": F.col("_metadata.file_block_start")})
    if rows is not None:
        # within a block of a file, ids rise in reading order; a block's first rows are enough of it
        raw = raw.withColumn("_id", F.monotonically_increasing_id())
        block = Window.partitionBy("_split", "_at").orderBy("_id")
        raw = raw.withColumn("_n", F.row_number().over(block)).where(F.col("_n") <= rows)
        raw = raw.withColumn("_n", F.row_number().over(Window.partitionBy("_split").orderBy("_at", "_id"))).where(F.col("_n") <= rows).drop("_id", "_n")
    raw = raw.drop("_at")
    flows = canonical_flow_log(raw, F.col("_split"), internal)
    return validate_flows(flows.select("split", *FLOW_COLUMNS, *(c for c in PACKET_STAT_COLUMNS if c in flows.columns)))


def quarantine(raw: DataFrame, captured: Column) -> DataFrame:
    """Adds ``_reject_reason``: the flow starts before its file's capture date, or carries no real label."""
    by_name = {c.strip(): c for c in raw.columns}
    when, label = F.col(f"`{by_name['Timestamp']}`"), F.col(f"`{by_name['Label']}`")
    early = parse_time(when) < captured.cast("timestamp")
    return raw.withColumn("_reject_reason", F.when(early, "before_capture_date").when(F.trim(label) == UNLABELLED, "label_-1"))


def read_dated_logs(spark: SparkSession, path, internal: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Day files named ``<weekday>-dd-MM-yyyy.csv``: (flows, rejected counts per split and reason)."""
    raw = _text_csv(spark, path).withColumn("_split", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{2}-\d{2}-\d{4})", 1))
    marked = quarantine(raw, F.to_date("_split", "dd-MM-yyyy"))
    dropped = (marked.where(F.col("_reject_reason").isNotNull()).groupBy(F.col("_split").alias("split"), F.col("_reject_reason").alias("reason"))
               .agg(F.count("*").alias("flows")))
    flows = canonical_flow_log(marked.where(F.col("_reject_reason").isNull()).drop("_reject_reason"), F.col("_split"), internal)
    return validate_flows(flows.select("split", *FLOW_COLUMNS, *(c for c in PACKET_STAT_COLUMNS if c in flows.columns))), dropped


def canonical_biflow(raw: DataFrame, split: Column) -> DataFrame:
    """Bi-flow text columns to canonical flows; 14 columns such logs do not record are 0."""
    missing = [c for c in BIFLOW_HEADER if c not in raw.columns]
    if missing:
        raise ValueError(f"bi-flow log lacks columns {missing}")
    proto = F.lower(F.trim("Proto"))
    protocol = F.when(proto == "tcp", 6).when(proto == "udp", 17).when(proto == "icmp", 1).otherwise(0)
    total, total_bytes, src_bytes = (F.col(c).try_cast("long") for c in ("TotPkts", "TotBytes", "SrcBytes"))
    forward, backward = biflow_packets(total, total_bytes, src_bytes, biflow_replied(F.col("State"), protocol))
    cols: dict[str, Column] = {
        "ts": F.try_to_timestamp("StartTime", F.lit(BIFLOW_TIME)), "src_ip": F.col("SrcAddr"), "src_port": parse_port(F.col("Sport")),
        "dst_ip": F.col("DstAddr"), "dst_port": parse_port(F.col("Dport")), "protocol": protocol,
        # durations are recorded in single precision
        "duration_us": F.col("Dur").try_cast("float").cast("double") * F.lit(1e6),
        "fwd_pkts": forward, "bwd_pkts": backward, "fwd_bytes": src_bytes,
        "bwd_bytes": F.greatest(total_bytes - src_bytes, F.lit(0)), "label": F.col("Label"), "attempted": F.lit(False),
        "stage": biflow_stage(F.col("Label"))}
    for letter, name in BIFLOW_FLAGS.items():
        cols[name] = F.when(protocol == 6, flag_sides(F.col("State"), letter)).otherwise(F.lit(0))
    for name in BIFLOW_UNRECORDED:
        cols[name] = F.lit(0)
    return validate_flows(raw.select(split.alias("split"), *(cols[c].cast(FLOW_TYPES[c]).alias(c) for c in FLOW_COLUMNS)))


def read_biflow(spark: SparkSession, path) -> DataFrame:
    """Bi-flow files; the split is the file's name."""
    raw = _text_csv(spark, path).withColumn("_split", F.regexp_replace(F.col("_metadata.file_name"), r"\.[a-z]+$", ""))
    return canonical_biflow(raw, F.col("_split"))


def time_slice(flows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Rows with start <= ts < stop (pushed to the scan of a parquet source)."""
    return flows.where((F.col("ts") >= start) & (F.col("ts") < stop))


def slice_report(flows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Per split, rows kept and seen; per label, rows kept."""
    inside = (F.col("ts") >= start) & (F.col("ts") < stop)
    return flows.groupBy("split", "label").agg(F.count_if(inside).alias("kept"), F.count("*").alias("total"))
