"""Attack labels -> ordered stages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.sizing import small_side
from tidewatch.schema import COMPROMISE_FROM, IMPACT, STAGE_TACTICS

# --- fixed values: label rules in order, first match wins (pattern, stage, technique, technique name) ----
LABEL_RULES: tuple[tuple[str, int, str, str], ...] = (
    (r"^benign$|^normal$|^background$", 0, "", ""),
    (r"infiltration.*(portscan|port scan|nmap)|portscan.*infiltration", 3, "T1046", "Network Service Discovery"),
    (r"infiltration.*cool ?disk", 3, "T1059.006", "Command and Scripting Interpreter: Python"),
    (r"infiltration.*communication", 4, "T1571", "Non-Standard Port"),
    (r"infiltration", 3, "T1204", "User Execution"),
    (r"\bbot(net)?\b|ares|c ?& ?c|command and control", 4, "T1071.001",
     "Application Layer Protocol: Web Protocols"),
    (r"exfil", 5, "T1041", "Exfiltration Over C2 Channel"),
    (r"ddos", 6, "T1498", "Network Denial of Service"),
    (r"\bdos\b|hulk|goldeneye|slowloris|slowhttptest|rudy|hoic|loic", 6, "T1499", "Endpoint Denial of Service"),
    (r"port ?scan|\bscan\b|probe|reconnaissance|\brecon\b", 1, "T1595.001", "Active Scanning: Scanning IP Blocks"),
    (r"patator|brute ?force|bruteforce|ftp|ssh", 2, "T1110.001", "Brute Force: Password Guessing"),
    (r"sql ?injection|sqli", 2, "T1190", "Exploit Public-Facing Application"),
    (r"\bxss\b|cross ?site", 2, "T1189", "Drive-by Compromise"),
    (r"heartbleed", 2, "T1190", "Exploit Public-Facing Application"),
    (r"web ?attack|shellshock|backdoor|exploit|worms?|shellcode", 2, "T1190", "Exploit Public-Facing Application"),
)
ATTEMPTED = r"\battempt(ed)?\b"
SCAN_WORDS = r"scan|nmap|probe"
BIFLOW_IMPACT = r"(?i)SPAM|DDoS|Flood|ICMP|-Ad-|Ad-|ClickFraud|Proxy"
BIFLOW_RECON = r"(?i)Attempt|Scan"

LABEL_LIMIT = 100_000


def normalise_label(label: Column) -> Column:
    """Lower-case, dashes of any spelling to spaces, the attempted suffix removed."""
    text = F.lower(F.trim(label))
    text = F.regexp_replace(text, "[‐-―�]+", "-")
    text = F.regexp_replace(text, ATTEMPTED, " ")
    text = F.regexp_replace(text, r"[_\-/]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_attempted(label: Column) -> Column:
    """P2."""
    return F.lower(label).rlike(ATTEMPTED)


def map_label(label: Column) -> Column:
    """struct(stage, tactic, technique, technique_name, attempted); an uncovered label is an error."""
    text = normalise_label(label)
    attempted = F.coalesce(is_attempted(label), F.lit(False))

    def meaning(stage: int, technique: str, name: str) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"), F.lit(STAGE_TACTICS[stage]).alias("tactic"),
            F.lit(technique).alias("technique"), F.lit(name).alias("technique_name"),
            attempted.alias("attempted"),
        )

    pattern, *rest = LABEL_RULES[0]
    chain = F.when(text.rlike(pattern), meaning(*rest))
    for pattern, *rest in LABEL_RULES[1:]:
        chain = chain.when(text.rlike(pattern), meaning(*rest))
    return chain.otherwise(F.raise_error(F.concat(F.lit("no stage rule covers label: "), F.coalesce(label, F.lit("null")))))


def refine_scan_direction(label: Column, stage: Column, src_ip: Column, internal: tuple[str, ...]) -> Column:
    """A scan launched from outside is reconnaissance, not lateral movement."""
    outside_scan = F.lower(label).rlike(SCAN_WORDS) & ~has_prefix(src_ip, internal) & (stage == 3)
    return F.when(outside_scan, F.lit(1)).otherwise(stage)


def biflow_stage(label: Column) -> Column:
    """P5: stage of a bi-flow capture's label (the text after the first ``=``)."""
    body = F.regexp_replace(label, "^[^=]*=", "")
    return (
        F.when(~body.startswith("From-Botnet") | label.isNull(), 0)
        .when(body.contains("CC"), 4)
        .when(body.rlike(BIFLOW_IMPACT), IMPACT)
        .when(body.rlike(BIFLOW_RECON), 1)
        .otherwise(4)
    )


def has_prefix(ip: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | ip.startswith(prefix)
    return F.coalesce(test, F.lit(False))


def map_distinct(df: DataFrame, column: str, value: Column, name: str, limit: int = LABEL_LIMIT) -> DataFrame:
    """Evaluate ``value`` once per distinct ``column`` and join it back.

    Only worth it where ``value`` is costly; the distinct values are broadcast when they are few (checked),
    and otherwise ``value`` is evaluated in place, row by row, with no join at all.
    """
    distinct, few = small_side(df.select(column).distinct(), limit)
    if not few:
        return df.withColumn(name, value)
    keyed = distinct.select(F.col(column).alias("_key"), value.alias(name))
    return df.join(F.broadcast(keyed), F.col(column).eqNullSafe(F.col("_key")), "left").drop("_key")


def with_stages(df: DataFrame, internal: tuple[str, ...], trusted_labels: bool = False) -> DataFrame:
    """P3 + P4 on flows: adds ``stage`` and ``attempted``.

    Labels are few, so the rules run once per distinct label and are joined back (checked broadcast).
    ``trusted_labels`` skips that pass over the input and evaluates the rules in place instead.
    """
    if trusted_labels:
        mapped = df.withColumn("_m", map_label(F.col("label")))
    else:
        mapped = map_distinct(df, "label", map_label(F.col("label")), "_m")
    stage = refine_scan_direction(F.col("label"), F.col("_m.stage"), F.col("src_ip"), internal)
    return mapped.withColumns({"stage": stage, "attempted": F.col("_m.attempted")}).drop("_m")


def effective_stage(include_attempted: bool = False) -> Column:
    """Attempted flows do not set a stage unless asked for."""
    if include_attempted:
        return F.col("stage")
    return F.when(F.coalesce(F.col("attempted"), F.lit(False)), F.lit(0)).otherwise(F.col("stage"))


def is_compromise(stage: Column, threshold: int = COMPROMISE_FROM) -> Column:
    """On the progression axis (impact is off it) and at or past ``threshold``."""
    return (stage >= threshold) & (stage < IMPACT)


def is_attack(stage: Column) -> Column:
    return stage > 0


def progression(stage: Column) -> Column:
    """The stage on the progression axis; impact and benign are 0."""
    return F.when(stage < IMPACT, stage).otherwise(F.lit(0))
