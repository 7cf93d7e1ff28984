"""Flows and packets derived from the test tables: the same SQL text runs in Spark and in the oracle.

Each text is a projection over one whole table, so its work grows with that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.labels import with_stages

INTERNAL = ("192.168.10.",)

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

#: one flow per event; split = week of the month
FLOW_SQL: dict[str, str] = {
    "split": "concat('week', cast(cast(floor((day(ts) - 1) / 7) as int) as string))",
    "flow_id": "event_id",
    "ts": "cast(ts as timestamp)",
    "src_ip": "case when user_id % 3 = 0 then concat('203.0.113.', cast(cast(user_id % 7 as int) as string)) "
              "else concat('192.168.10.', cast(cast(user_id % 50 as int) as string)) end",
    "src_port": "cast(40000 + event_id % 2000 as int)",
    "dst_ip": "case when (event_id + k) % 4 = 0 then concat('198.51.100.', cast(cast(k % 9 as int) as string)) "
              "else concat('192.168.10.', cast(cast((event_id * 7 + k) % 50 as int) as string)) end",
    "dst_port": "cast(case when k < 20 then 80 when k < 40 then 443 when k < 50 then 53 when k < 60 then 22 "
                "when k < 70 then 445 else 1000 + event_id % 40 end as int)",
    "protocol": "cast(case when event_type = 'view' then 17 when event_type = 'signup' and k < 10 then 1 else 6 end as int)",
    "duration_us": "cast(k * 1000000 as double)",
    "fwd_pkts": "cast(1 + k % 7 as bigint)",
    "bwd_pkts": "cast(case when event_type = 'error' then 0 else k % 5 end as bigint)",
    "fwd_bytes": "cast(floor(value * 10) as bigint)",
    "bwd_bytes": "cast(case when event_type = 'error' then 0 else k * 20 end as bigint)",
    "flow_iat_mean": "cast(k * 10 as double)",
    "flow_iat_std": "cast(k % 13 as double)",
    "flow_iat_max": "cast(k * 25 as double)",
    "flow_iat_min": "cast(1 + k % 3 as double)",
    "fin_cnt": "cast(k % 2 as bigint)",
    "syn_cnt": "cast(k % 3 as bigint)",
    "rst_cnt": "cast(case when k % 11 = 0 then 1 else 0 end as bigint)",
    "psh_cnt": "cast(k % 5 as bigint)",
    "ack_cnt": "cast(case when event_type = 'error' then 0 else k % 4 end as bigint)",
    "urg_cnt": "cast(case when k = 7 then 1 else 0 end as bigint)",
    "cwr_cnt": "cast(0 as bigint)",
    "ece_cnt": "cast(0 as bigint)",
    "pkt_len_min": "cast(k % 20 as double)",
    "pkt_len_max": "cast(k * 15 as double)",
    "pkt_len_mean": "cast((k * k) % 1400 as double)",
    "pkt_len_std": "cast(k % 17 as double)",
    "down_up_ratio": "cast(k % 5 as double)",
    "fwd_init_win": "cast(case when k % 9 = 0 then 0 when k % 10 = 1 then 512 else 1024 * (k % 8) end as bigint)",
    "bwd_init_win": "cast(case when event_type = 'error' then 0 else 256 * (k % 6) end as bigint)",
    "fwd_seg_size_min": "cast(20 + 4 * (k % 4) as bigint)",
    "active_mean": "cast(k * 3 as double)",
    "idle_mean": "cast(k * 7 as double)",
    "label": "case when event_type = 'error' and k >= 90 then 'Portscan' "
             "when event_type = 'error' and k >= 85 then 'FTP-Patator - Attempted' "
             "when event_type = 'signup' and k >= 95 then 'Infiltration - Portscan' "
             "when event_type = 'purchase' and k >= 97 then 'Botnet' "
             "when event_type = 'click' and k >= 95 then 'DDoS' else 'BENIGN' end",
    "fwd_pkt_len_std": "cast(k % 11 as double)",
    "bwd_pkt_len_std": "cast(k % 7 as double)",
    "fwd_iat_std": "cast(k % 23 as double)",
    "bwd_iat_std": "cast(k % 19 as double)",
    "fwd_rst_cnt": "cast(case when k % 22 = 0 then 1 else 0 end as bigint)",
    "bwd_rst_cnt": "cast(case when k % 11 = 0 then 1 else 0 end as bigint)",
    "fwd_hdr_bytes": "cast((1 + k % 7) * (20 + 4 * (k % 4)) as bigint)",
    "fwd_data_pkts": "cast(case when k % 6 = 0 then 0 else k % 7 end as bigint)",
}

#: the label -> stage outcome for the labels above, as plain SQL for the oracle
STAGE_SQL = ("cast(case label when 'BENIGN' then 0 when 'Portscan' then 1 when 'FTP-Patator - Attempted' then 2 "
             "when 'Infiltration - Portscan' then case when starts_with(src_ip, '192.168.10.') then 3 else 1 end "
             "when 'Botnet' then 4 when 'DDoS' then 6 end as int)")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a canonical flow, stages mapped by the library's own label rules."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", f"{_K} as k")
    raw = base.selectExpr(*(f"{text} as {name}" for name, text in FLOW_SQL.items()))
    return with_stages(raw, internal=INTERNAL, trusted_labels=True)


#: one packet per line item. frame_no comes from the row's own columns, so no global sort is needed.
_P = "(l_orderkey * 8 + l_linenumber)"
PACKET_SQL: dict[str, str] = {
    "split": "concat('cap', cast(cast(l_orderkey % 4 as int) as string))",
    "capture": "concat('cap', cast(cast(l_orderkey % 4 as int) as string), '.pcap')",
    "frame_no": f"cast(({_P} * 32768 + l_partkey) * 1024 + l_suppkey as bigint)",
    "at_us": f"cast(1704067200000000 + {_P} * 6000 + l_partkey % 1000 as bigint)",
    "src_ip": "case when l_linenumber % 2 = 0 then concat('203.0.113.', cast(cast(l_suppkey % 20 as int) as string)) "
              "else concat('192.168.10.', cast(cast(l_partkey % 50 as int) as string)) end",
    "dst_ip": "case when l_linenumber % 2 = 0 then concat('192.168.10.', cast(cast(l_partkey % 50 as int) as string)) "
              "else concat('203.0.113.', cast(cast(l_suppkey % 20 as int) as string)) end",
    "protocol": "cast(case when l_partkey % 5 = 0 then 17 when l_partkey % 97 = 0 then 1 else 6 end as int)",
    "src_port": "cast(case when l_linenumber % 2 = 0 then 80 else 40000 + l_partkey % 3 end as int)",
    "dst_port": "cast(case when l_linenumber % 2 = 0 then 40000 + l_partkey % 3 when l_suppkey % 3 = 0 then 80 + l_suppkey % 30 else 80 end as int)",
    "ttl": "cast(case when l_suppkey % 4 = 0 then 52 + l_linenumber else 64 + l_suppkey % 3 end as int)",
    "more_frags": "l_partkey % 41 = 0",
    "frag_off": "cast(0 as int)",
    "tcp_flags": "cast(case when l_partkey % 5 = 0 or l_partkey % 97 = 0 then 0 when l_quantity < 5 then 2 "
                 "when l_quantity < 8 then 4 when l_quantity < 12 then 17 else 16 end as int)",
    "seq": "cast((l_suppkey * 1000 + cast(l_quantity as bigint) * 100) % 4294967296 as bigint)",
    "tcp_win": "cast(case when l_linenumber = 3 then 0 else 256 * (l_partkey % 9) end as int)",
    "hdr_len": "cast(case when l_partkey % 5 = 0 then 8 else 20 + 4 * (l_linenumber % 3) end as int)",
    "payload_len": "cast(case when l_quantity < 12 then 0 else cast(l_quantity as bigint) * 29 end as int)",
}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = raw.selectExpr(*(f"{text} as {name}" for name, text in PACKET_SQL.items()))
    return out.withColumn("ts", F.timestamp_micros("at_us")).drop("at_us")
