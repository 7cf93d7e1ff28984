"""Custom streaming state (X3, X5, X6, X7, X9): ``transformWithStateInPandas`` processors.

State per key is bounded: one open flow per tuple, a fixed number of trailing rows, or a first-seen set with a
time to live. Where the batch operator is exact over all history, the processor keeps the same history.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import ordered
from tidewatch.operators.flows import ACK, ENDS, FIN, RST, SYN, TIMEOUT_US, flow_packets, with_ends
from tidewatch.operators.ordered import Counted, packed, unpacked
from tidewatch.schema import BASELINE_MIN, BASELINE_WINDOWS, TREND_BASES, TREND_SLOPES, Z_CLIP

# The process that sets a stream's processors up does not see files added to the application, so processors
# travel by value instead of by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(ordered)


def _us(values: pd.Series) -> np.ndarray:
    return values.to_numpy("datetime64[us]").astype("int64")


# --- X3: flow expiry --------------------------------------------------------------------------------------

FLOW_OUT = ("split string, protocol int, ip_a string, port_a int, ip_b string, port_b int, first_ts timestamp, last_ts timestamp, "
            "from_a boolean, pkts bigint, a_pkts bigint, b_pkts bigint, a_bytes bigint, b_bytes bigint")
_FLOW_STATE = ("first_us bigint, last_us bigint, forward_a boolean, pkts bigint, a_pkts bigint, a_bytes bigint, b_bytes bigint, "
               "fin_a boolean, fin_b boolean, rst boolean")


class FlowExpiry(StatefulProcessor):
    """One open flow per tuple; it is emitted when the next one starts, or by an event-time timer 120 s after its
    first packet. The timer fires once the watermark (capture time less the allowed disorder) has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _FLOW_STATE)
        self.direction = handle.getValueState("direction", "forward_a boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["capture", "frame_no"])
        done: list[tuple] = []
        current = list(self.open.get()) if self.open.exists() else None
        known = self.direction.get()[0] if self.direction.exists() else None
        for us, from_a, flags, size in zip(_us(table["ts"]), table["from_a"], table["tcp_flags"].fillna(0).astype(int), table["payload_len"]):
            us, from_a, size = int(us), bool(from_a), int(size)
            syn = bool(flags & SYN) and not flags & ACK
            if current is not None:
                closing = current[9] or (current[7] and current[8])
                if us - current[0] > TIMEOUT_US or (syn and closing):
                    done.append(tuple(current))
                    current = None
            if current is None:
                forward = from_a if syn or known is None else known
                known = forward
                current = [us, us, forward, 0, 0, 0, 0, False, False, False]
            current[1] = us
            current[3] += 1
            if from_a:
                current[4] += 1
                current[5] += size
            else:
                current[6] += size
            if flags & FIN:
                current[7 if from_a else 8] = True
            current[9] = current[9] or bool(flags & RST)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update(tuple(current))
        self.direction.update((known,))
        self.handle.registerTimer(int((current[0] + TIMEOUT_US) // 1000 + 1))
        if done:
            yield _flow_rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            flow = tuple(self.open.get())
            self.open.clear()
            yield _flow_rows(key, [flow])

    def close(self) -> None:
        pass


def _flow_rows(key, flows: list[tuple]) -> pd.DataFrame:
    kept = [f for f in flows if f[3] >= 2]  # single-packet flows are not reported
    out = pd.DataFrame([dict(zip(ENDS, key)) | {
        "first_ts": pd.Timestamp(f[0], unit="us"), "last_ts": pd.Timestamp(f[1], unit="us"), "from_a": f[2], "pkts": f[3], "a_pkts": f[4],
        "b_pkts": f[3] - f[4], "a_bytes": f[5], "b_bytes": f[6]} for f in kept],
        columns=[*ENDS, "first_ts", "last_ts", "from_a", "pkts", "a_pkts", "b_pkts", "a_bytes", "b_bytes"])
    return out


def live_flows(packets: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Flows as they end, packets of a micro-batch in capture order as in the batch form. ``from_a`` is the forward end.

    Disorder up to ``delay`` is tolerated.
    """
    rows = with_ends(flow_packets(packets)).withWatermark("ts", delay).select(*ENDS, "ts", "capture", "frame_no", "from_a", "tcp_flags", "payload_len")
    return rows.groupBy(*ENDS).transformWithStateInPandas(FlowExpiry(), outputStructType=FLOW_OUT, outputMode="Append", timeMode="EventTime")


# --- X5: causal threshold ---------------------------------------------------------------------------------

class CausalThreshold(StatefulProcessor):
    """Every past score of a split in counted blocks, exactly as the batch operator sees it.

    A batch reads the index (two numbers per block of up to 512 scores) and the blocks it inserts into or takes the
    quantile from, and writes back what it changed.
    """

    def __init__(self, quantile: float, warmup: int) -> None:
        self.quantile, self.warmup = quantile, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "lows binary, counts binary, ids binary")
        self.blocks = handle.getMapState("blocks", "id bigint", "cell binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("w")
        index = None
        if self.index.exists():
            lows, counts, ids = (unpacked(bytes(c)) for c in self.index.get())
            index = (lows, [int(c) for c in counts], [int(i) for i in ids])
        past = Counted(index, lambda number: unpacked(bytes(self.blocks.getValue((number,))[0])))
        out = []
        for score in table["score"]:
            out.append(past.quantile(self.quantile) if past.size >= self.warmup else None)
            past.insert(float(score))
        for number in past.changed:
            self.blocks.updateValue((number,), (packed(past.blocks[number]),))
        self.index.update((packed(past.lows), packed([float(c) for c in past.counts]), packed([float(i) for i in past.ids])))
        limits = pd.Series(out, dtype="float64", index=table.index)
        yield pd.DataFrame({"split": key[0], "w": table["w"], "ts": table["ts"], "score": table["score"], "threshold": limits,
                            "alarm": (table["score"] >= limits)})

    def close(self) -> None:
        pass


def live_threshold(scores: DataFrame, quantile: float = 0.90, warmup: int = 20) -> DataFrame:
    """Scores (split, w, ts, score), in window order per split, with threshold and alarm as they arrive."""
    return scores.select("split", "w", "ts", "score").groupBy("split").transformWithStateInPandas(
        CausalThreshold(quantile, warmup), outputStructType="split string, w bigint, ts timestamp, score double, threshold double, alarm boolean",
        outputMode="Append", timeMode="None")


# --- X6: trailing trend -----------------------------------------------------------------------------------

TREND_ROWS = 512  # rows worked on at once; each looks back at BASELINE_WINDOWS rows


def _trend(past: np.ndarray, now: np.ndarray) -> dict[str, np.ndarray]:
    """Delta, slopes and z-score (rows x columns) of the rows ``now`` after the rows ``past``; column 0 of both is w."""
    missing = np.full((BASELINE_WINDOWS - len(past), now.shape[1]), np.nan)
    every = np.concatenate([missing, past, now])
    values = every[:, 1:]
    behind = np.lib.stride_tricks.sliding_window_view(values, BASELINE_WINDOWS, axis=0)[:len(now)]
    count = (~np.isnan(behind)).sum(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(behind, -1) / count
        spread = np.sqrt(np.nansum((behind - mean[..., None]) ** 2, -1) / (count - 1))
        z = np.clip((now[:, 1:] - mean) / np.maximum(spread, 1e-6), -Z_CLIP, Z_CLIP)
    out = {"delta": np.nan_to_num(now[:, 1:] - values[BASELINE_WINDOWS - 1:-1])}
    for span in TREND_SLOPES:
        first = BASELINE_WINDOWS - span + 1
        frame = np.lib.stride_tricks.sliding_window_view(every, span, axis=0)[first:first + len(now)]
        x = frame[:, :1] - frame[:, :1].mean(-1, keepdims=True)
        out[f"slope_{span}"] = np.nan_to_num((x * frame[:, 1:]).sum(-1) / (x * x).sum(-1))
    return out | {"zscore": np.where(count >= BASELINE_MIN, z, 0.0)}


class TrailingTrend(StatefulProcessor):
    """The last ``BASELINE_WINDOWS`` rows of a split: enough for the z-score and for every slope."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", ", ".join(f"{c} double" for c in ("w", *(f"v{i}" for i in range(len(self.columns))))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("w")
        new = table[["w", *self.columns]].to_numpy(float)
        past = np.array([tuple(r) for r in self.past.get()], float).reshape(-1, new.shape[1])
        for i in range(0, len(new), TREND_ROWS):
            now = new[i:i + TREND_ROWS]
            found = _trend(past, now)
            yield pd.DataFrame({"split": key[0], "w": now[:, 0].astype("int64")} | {
                f"{c}_{kind}": found[kind][:, j] for kind in found for j, c in enumerate(self.columns)})
            past = np.concatenate([past, now])[-BASELINE_WINDOWS:]
        self.past.put([tuple(r) for r in past.tolist()])

    def close(self) -> None:
        pass


def live_trend(states: DataFrame, columns: tuple[str, ...] = TREND_BASES) -> DataFrame:
    """The trend features of the batch form (delta, slopes, trailing z-score), for states arriving in window order per split.

    Values are numbers, not null. A split keeps ``BASELINE_WINDOWS`` rows.
    """
    kinds = ("delta", *(f"slope_{n}" for n in TREND_SLOPES), "zscore")
    schema = "split string, w bigint, " + ", ".join(f"{c}_{kind} double" for kind in kinds for c in columns)
    return states.select("split", "w", *(F.col(c).cast("double").alias(c) for c in columns)).groupBy("split").transformWithStateInPandas(
        TrailingTrend(columns), outputStructType=schema, outputMode="Append", timeMode="None")


# --- X7: first-seen sets ----------------------------------------------------------------------------------

class FirstSeen(StatefulProcessor):
    """Which values of a column a host has used; each entry lives ``ttl_ms`` (0 = for ever)."""

    def __init__(self, column: str, ttl_ms: int) -> None:
        self.column, self.ttl_ms = column, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "us bigint", ttlDurationMs=self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("ts")
        fresh = []
        for us, ts, value in zip(_us(table["ts"]), table["ts"], table[self.column].astype(str)):
            if not self.seen.containsKey((value,)):
                self.seen.updateValue((value,), (int(us),))
                fresh.append({"split": key[0], "src_ip": key[1], "ts": ts, "value": value})
        if fresh:
            yield pd.DataFrame(fresh)

    def close(self) -> None:
        pass


def live_first_seen(flows: DataFrame, column: str, ttl_ms: int = 0) -> DataFrame:
    """(split, src_ip, ts, value) the first time a host uses a peer or port. Batches must arrive in time order."""
    return flows.select("split", "src_ip", "ts", column).groupBy("split", "src_ip").transformWithStateInPandas(
        FirstSeen(column, ttl_ms), outputStructType="split string, src_ip string, ts timestamp, value string", outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None")


# --- X9: recent ports -------------------------------------------------------------------------------------

class RecentPorts(StatefulProcessor):
    """The last ``keep`` destination ports of a source, and the verdict they give after every micro-batch."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ports = handle.getListState("ports", "port int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "frame_no"])
        ports = ([r[0] for r in self.ports.get()] + [int(p) for p in table["dst_port"]])[-self.keep:]
        self.ports.put([(p,) for p in ports])
        yield pd.DataFrame({"split": [key[0]], "src_ip": [key[1]], "ts": [table["ts"].max()], "signature": [_verdict(ports)]})

    def close(self) -> None:
        pass


def _verdict(ports: list[int]) -> str:
    walk = [p for i, p in enumerate(ports) if i == 0 or p != ports[i - 1]]
    if len(ports) < 15 or len(walk) < 5:
        return "benign"
    steps = np.abs(np.diff(walk))
    ratio = float((steps == 1).mean())
    if ratio > 0.6:
        return "sequential_scan"
    return "randomised_scan" if ratio < 0.1 and len(set(ports)) > 10 else "benign"


def live_port_signatures(packets: DataFrame, keep: int = 100) -> DataFrame:
    """A source's verdict after each micro-batch."""
    return flow_packets(packets).select("split", "src_ip", "ts", "frame_no", "dst_port").groupBy("split", "src_ip").transformWithStateInPandas(
        RecentPorts(keep), outputStructType="split string, src_ip string, ts timestamp, signature string", outputMode="Append", timeMode="None")
