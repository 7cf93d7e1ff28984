"""Per-row column expressions: flow shape, ports, bi-flow packet split, JSON-safe numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schema import SERVICE_PORTS

PAYLOAD_EDGES = (0.5, 64.5, 512.5, 1024.5)


def clean(col: Column) -> Column:
    """NaN -> null, so aggregates skip it."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def json_safe(col: Column) -> Column:
    """NaN and both infinities become null."""
    value = col.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def flow_shape(internal: tuple[str, ...]) -> dict[str, Column]:
    """P10: the per-flow quantities the window aggregates read; tests come back as booleans.

    Written as SQL text: one expression each to parse, where composing columns would cross into the JVM per node.
    """
    src_in, dst_in = (_prefix_text(c, internal) for c in ("src_ip", "dst_ip"))
    out, back = f"({src_in} and not {dst_in})", f"(not {src_in} and {dst_in})"
    text = {
        "pkts": "fwd_pkts + bwd_pkts", "bytes": "fwd_bytes + bwd_bytes", "duration_s": "nanvl(cast(duration_us as double), null) / 1e6D",
        "syn_no_ack": "syn_cnt > 0 and ack_cnt = 0", "has_rst": "rst_cnt > 0", "has_fin": "fin_cnt > 0",
        "one_way": "bwd_pkts = 0", "tiny_flow": "fwd_pkts + bwd_pkts <= 2",
        "priv_port": "dst_port < 1024", "ephemeral_dst": "dst_port >= 32768",
        "src_internal": src_in, "is_outbound": out, "is_inbound": back, "is_internal": f"({src_in} and {dst_in})",
        "proto_tcp": "protocol = 6", "proto_udp": "protocol = 17", "proto_icmp": "protocol = 1",
        "outbound_bytes": f"case when {out} then fwd_bytes when {back} then bwd_bytes else 0 end",
        "inbound_bytes": f"case when {out} then bwd_bytes when {back} then fwd_bytes else 0 end",
        **{f"svc_{name}": f"dst_port in ({', '.join(map(str, ports))})" for name, ports in SERVICE_PORTS.items()},
    }
    return {name: F.expr(sql) for name, sql in text.items()}


def _prefix_text(column: str, prefixes: tuple[str, ...]) -> str:
    """SQL text of "the address starts with one of the prefixes" (a missing address does not)."""
    if not all(set(p) <= set("0123456789abcdefABCDEF.:") for p in prefixes):
        raise ValueError(f"address prefixes may hold only digits, letters a-f, dots and colons: {prefixes}")
    tests = " or ".join(f"startswith({column}, '{p}')" for p in prefixes) or "false"
    return f"coalesce({tests}, false)"


def parse_port(text: Column) -> Column:
    """Decimal, 0x hex (and 0o / 0b), anything else 0."""
    t = F.lower(F.trim(text))
    value = (
        F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 64), 16, 10))
        .when(t.rlike("^0o[0-7]+$"), F.conv(F.substring(t, 3, 64), 8, 10))
        .when(t.rlike("^0b[01]+$"), F.conv(F.substring(t, 3, 64), 2, 10))
        .when(t.rlike("^([1-9][0-9]*|0+)$"), t)
    )
    return F.coalesce(value.try_cast("int"), F.lit(0))


def biflow_replied(state: Column, protocol: Column) -> Column:
    """Whether the destination answered: TCP, anything after the first ``_``; otherwise state is not INT."""
    tcp_reply = F.length(F.regexp_extract(state, "_(.*)$", 1)) > 0
    return F.coalesce(F.when(protocol == 6, tcp_reply).otherwise(state != "INT"), F.lit(False))


def biflow_packets(total: Column, total_bytes: Column, src_bytes: Column, replied: Column) -> tuple[Column, Column]:
    """(forward, backward) packets, by the source's share of bytes; half rounds to even."""
    share = F.when(total_bytes > 0, src_bytes / total_bytes).otherwise(F.lit(1.0))
    ceiling = F.greatest(total - 1, F.lit(1))
    split = F.least(F.greatest(F.bround(total * share), F.lit(1.0)), ceiling.cast("double")).cast("long")
    forward = F.when(replied, split).otherwise(total)
    backward = F.when(replied, F.greatest(total - forward, F.lit(1))).otherwise(F.lit(0))
    return forward.cast("long"), backward.cast("long")


def flag_sides(state: Column, letter: str) -> Column:
    """On how many sides (0-2) of a ``S_SA`` state string a flag letter is seen."""
    sides = F.slice(F.split(state, "_"), 1, 2)
    return F.coalesce(F.size(F.filter(sides, lambda side: side.contains(letter))), F.lit(0)).cast("long")


def bin_of(value: Column, edges=PAYLOAD_EDGES) -> Column:
    """Index of the half-open bin ``value`` falls in (0 .. len(edges))."""
    return reduce(lambda total, edge: total + (value >= edge).cast("int"), edges, F.lit(0))


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def entropy_bits(count_sum: Column, clogc_sum: Column) -> Column:
    """A5: Shannon entropy from sum(c) and sum(c*log2 c) of a count distribution, never below 0."""
    return F.greatest(F.log2(count_sum) - clogc_sum / count_sum, F.lit(0.0))
