"""Dimension tables (S14): stages, attack schedule, capture families, service ports. All are fixed and tiny."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import SERVICE_PORTS, STAGE_TACTICS, STAGE_TITLES, STAGES

# --- fixed values: published attack schedule, UTC (split, start, end, attack) ----------------------------
ATTACK_SCHEDULE: tuple[tuple[str, str, str, str], ...] = (
    ("tuesday", "2017-07-04 12:20", "2017-07-04 13:20", "FTP-Patator"),
    ("tuesday", "2017-07-04 17:00", "2017-07-04 18:00", "SSH-Patator"),
    ("wednesday", "2017-07-05 12:47", "2017-07-05 13:10", "DoS Slowloris"),
    ("wednesday", "2017-07-05 13:14", "2017-07-05 13:35", "DoS Slowhttptest"),
    ("wednesday", "2017-07-05 13:43", "2017-07-05 14:00", "DoS Hulk"),
    ("wednesday", "2017-07-05 14:10", "2017-07-05 14:23", "DoS GoldenEye"),
    ("wednesday", "2017-07-05 18:12", "2017-07-05 18:32", "Heartbleed"),
    ("thursday", "2017-07-06 12:20", "2017-07-06 13:00", "Web Attack - Brute Force"),
    ("thursday", "2017-07-06 13:15", "2017-07-06 13:35", "Web Attack - XSS"),
    ("thursday", "2017-07-06 13:40", "2017-07-06 13:42", "Web Attack - SQL Injection"),
    ("thursday", "2017-07-06 17:19", "2017-07-06 17:21", "Infiltration (Dropbox/Meterpreter)"),
    ("thursday", "2017-07-06 17:33", "2017-07-06 17:35", "Infiltration (2nd stage)"),
    ("thursday", "2017-07-06 17:53", "2017-07-06 18:00", "Infiltration - Cool Disk (MAC)"),
    ("thursday", "2017-07-06 18:04", "2017-07-06 18:45", "Infiltration - internal NMAP portscan"),
    ("friday", "2017-07-07 13:02", "2017-07-07 14:02", "Botnet ARES"),
    ("friday", "2017-07-07 16:55", "2017-07-07 18:27", "PortScan"),
    ("friday", "2017-07-07 18:56", "2017-07-07 19:16", "DDoS LOIC"),
)

# --- fixed values: bi-flow scenario -> botnet family ----------------------------------------------------
SCENARIO_FAMILIES: dict[int, str] = {
    1: "Neris", 2: "Neris", 3: "Rbot", 4: "Rbot", 5: "Virut", 6: "Menti", 7: "Sogou", 8: "Murlo", 9: "Neris",
    10: "Rbot", 11: "Rbot", 12: "NSIS.ay", 13: "Virut",
}


def stage_catalogue_column() -> Column:
    """The stage catalogue as an array of structs, for payloads."""
    return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(title).alias("label"),
                              F.lit(tactic).alias("tactic"))
                     for i, (name, title, tactic) in enumerate(zip(STAGES, STAGE_TITLES, STAGE_TACTICS))))


def stage_catalogue(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(stage_catalogue_column()).alias("s")).select("s.*")


def attack_schedule(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(ATTACK_SCHEDULE), "split string, start string, end string, attack string")
    return rows.withColumns({c: F.to_timestamp(c, "yyyy-MM-dd HH:mm") for c in ("start", "end")})


def scenario_families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{n:02d}", fam) for n, fam in SCENARIO_FAMILIES.items()], "split string, family string")


def service_ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, p) for name, ports in SERVICE_PORTS.items() for p in ports], "service string, port int")
