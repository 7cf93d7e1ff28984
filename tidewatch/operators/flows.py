"""Packets -> bidirectional flows (F1-F3), per-session packet statistics (F4), port-scan signatures.

A flow lasts at most 120 s from its first packet, and a pure SYN starts a new one once the old one is closing
(FIN from both sides, or an RST). Which packet starts a flow depends on the packets before it, but only through the flow
that is open: so packets are dealt into sorted stretches, each stretch is summed up as a function of the open flow, and these
functions are chained. One shuffle of packets; a flow's statistics are taken where its packets lie, in order, and only flows
that cross a border are put together from pieces.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import zero_if_null
from tidewatch.operators.grid import _div
from tidewatch.operators.stretches import STRETCH, dealt, key_at, key_changes
from tidewatch.session import cut_lineage, let_go

TIMEOUT_US = 120_000_000
ACTIVITY_US = 5_000_000
FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x40, 0x80
#: flag bit -> flow column
FLAG_COLUMNS = {FIN: "fin_cnt", SYN: "syn_cnt", RST: "rst_cnt", PSH: "psh_cnt", ACK: "ack_cnt", URG: "urg_cnt",
                ECE: "ece_cnt", CWR: "cwr_cnt"}
ENDS = ["split", "protocol", "ip_a", "port_a", "ip_b", "port_b"]
ORDER = ["capture", "frame_no"]


def has_flag(bits: int, flags: Column | None = None) -> Column:
    return (F.col("tcp_flags") if flags is None else flags).bitwiseAND(F.lit(bits)) > 0


def pure_syn() -> Column:
    return has_flag(SYN) & ~has_flag(ACK)


def with_ends(packets: DataFrame) -> DataFrame:
    """The unordered 5-tuple: end A is the smaller (address, port); ``from_a`` tells who sent the packet.

    A packet whose two ends are equal counts as sent by A.
    """
    a, b = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    from_a = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    return packets.withColumn("from_a", from_a).withColumns({
        "ip_a": F.when(F.col("from_a"), F.col("src_ip")).otherwise(F.col("dst_ip")),
        "port_a": F.when(F.col("from_a"), F.col("src_port")).otherwise(F.col("dst_port")),
        "ip_b": F.when(F.col("from_a"), F.col("dst_ip")).otherwise(F.col("src_ip")),
        "port_b": F.when(F.col("from_a"), F.col("dst_port")).otherwise(F.col("src_port"))})


def flow_packets(packets: DataFrame) -> DataFrame:
    """Packets the flow route reads: TCP and UDP, later IP fragments left out."""
    return packets.where(F.col("protocol").isin(6, 17) & (F.col("frag_off") == 0))


#: what a stretch's packets carry from its last flow into the next stretch: time of the flow's first packet, what closes it (1 FIN
#: from A, 2 FIN from B, 3 closed), the flow's number, times of the last packet, of the last from A, from B, and since when it is active
OPEN = ("first", "closing", "number", "last", "last_a", "last_b", "opened")
NEVER = -(1 << 62)


class Packets:
    """Consecutive packets of some tuples as arrays; a segment is one tuple's share."""

    def __init__(self, us: np.ndarray, flags: np.ndarray, from_a: np.ndarray, begins: np.ndarray, known: np.ndarray | None = None):
        self.us, self.from_a, self.count = us, from_a, len(us)
        self.known = np.ones(self.count, bool) if known is None else known  # whether ``from_a`` is
        self.begins = begins  # first row of each segment
        self.ends = np.append(begins[1:], self.count)
        self.segment = np.repeat(np.arange(len(begins)), self.ends - begins)
        self.end = self.ends[self.segment]
        fin = flags & FIN > 0
        self.fin_a, self.fin_b, self.rst = fin & from_a, fin & ~from_a, flags & RST > 0
        self.syn = (flags & SYN > 0) & (flags & ACK == 0)

    def sides(self, mask: np.ndarray | bool = True) -> np.ndarray:
        """For each row who sent it: 1 end A, 0 end B, -1 where that is unknown or ``mask`` does not hold."""
        return np.where(self.known & mask, self.from_a, -1).astype(np.int8)

    def following(self, mask: np.ndarray) -> np.ndarray:
        """For each row the first row at or after it, in its segment, where ``mask`` holds; the segment's end where none does."""
        rows = np.where(mask, np.arange(self.count), self.count)
        return np.minimum(np.minimum.accumulate(rows[::-1])[::-1], self.end)

    def later_than(self, rows: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each of ``rows`` the first row from it on, in its segment, whose time is over ``limit``; the segment's end where none is."""
        low = int(self.us.min())
        span = int(self.us.max()) - low + TIMEOUT_US + 2
        if len(self.begins) * span < 1 << 61:
            # running maxima of all segments on one rising axis
            axis = self.segment * span
            top = np.maximum.accumulate(self.us - low + axis)
            found = np.searchsorted(top, np.clip(limit - low, -1, span - 2) + axis[rows], "right")
        else:
            found = np.empty(len(rows), np.int64)
            for k in np.unique(self.segment[rows]):
                a, b = self.begins[k], self.ends[k]
                own = self.segment[rows] == k
                found[own] = a + np.searchsorted(np.maximum.accumulate(self.us[a:b]), limit[own], "right")
        found = np.minimum(found, self.end[rows])
        for i in np.flatnonzero(found < rows):  # a packet before it was later already
            over = np.flatnonzero(self.us[rows[i]:self.end[rows[i]]] > limit[i])
            found[i] = rows[i] + over[0] if len(over) else self.end[rows[i]]
        return found

    def nexts(self) -> np.ndarray:
        """For each row where the flow after the one that begins there begins; the segment's end if in no row of it."""
        if not self.count:
            return np.zeros(0, np.int64)
        closes = np.minimum(self.following(self.rst), np.maximum(self.following(self.fin_a), self.following(self.fin_b)))
        syn = np.append(self.following(self.syn), self.count)
        reopened = np.minimum(np.where(closes < self.end, syn[np.minimum(closes + 1, self.count)], self.end), self.end)
        return np.minimum(reopened, self.later_than(np.arange(self.count), self.us + TIMEOUT_US))

    def first_after(self, closing: int) -> int:
        """Where a pure SYN ends a flow that entered the first segment half closed, by ``closing``; its end if nowhere."""
        end = int(self.ends[0])
        closes = -1
        if closing < 3:
            fins = [self.following(m)[0] for bit, m in ((1, self.fin_a), (2, self.fin_b)) if not closing & bit]
            closes = min(int(self.following(self.rst)[0]), max(int(f) for f in fins))
        return int(self.following(self.syn)[closes + 1]) if closes + 1 < end else end

    def entered(self, state: tuple) -> int:
        """Where the first segment's first new flow begins, when ``state`` was open before it."""
        over = self.later_than(np.zeros(1, np.int64), np.array([state[0] + TIMEOUT_US]))
        return min(int(over[0]), self.first_after(state[1]))


def _last(mask: np.ndarray) -> int:
    rows = np.flatnonzero(mask)
    return int(rows[-1]) if len(rows) else -1


class Summary:
    """A stretch of one tuple as a function from the state before it to the state after it.

    Whatever flow was open, the first new one begins where its time is up or a SYN meets it closed; from there on
    all is settled, so it is enough to know, for each row, the last flow of the chain that begins there, and the way the last of
    them runs that a SYN opens. Chains come by pointer jumping over ``nexts``.
    """

    def __init__(self, p: Packets):
        jump, n = p.nexts(), p.count
        rows = np.arange(n)
        last, steps = np.where(jump < n, jump, rows), (jump < n).astype(np.int64)
        opened = p.sides(p.syn)
        way = np.where(jump < n, opened, np.int8(-1))  # of the chain's flows before ``last``
        while True:
            further = last[last]
            if (further == last).all():
                break
            steps += steps[last]
            way = np.where(way[last] >= 0, way[last], way)
            last = further
        self.way, self.first_way = np.where(opened[last] >= 0, opened[last], way), int(p.sides()[0])
        self.top, self.reopens = np.maximum.accumulate(p.us), [p.first_after(c) for c in range(4)]
        self.us, self.last, self.steps, self.count = p.us, last.astype(np.int32), steps.astype(np.int32), n
        self.bits = [_last(p.fin_a), _last(p.fin_b), _last(p.rst)]
        pause = np.zeros(n, bool)
        pause[1:] = np.diff(p.us) > ACTIVITY_US
        self.marks = [_last(p.from_a), _last(~p.from_a), _last(pause)]

    def _settled(self, first_row: int, first_us: int, closing: int, number: int, carried: tuple) -> tuple:
        seen = [at >= max(first_row, 0) for at in self.bits]
        closing = 3 if closing == 3 or seen[2] else closing | (1 if seen[0] else 0) | (2 if seen[1] else 0)
        a, b, pause = (int(self.us[at]) if at >= max(first_row, 0) else old for at, old in zip(self.marks, carried))
        if self.marks[2] <= first_row and first_row >= 0:
            pause = first_us
        return first_us, closing, number, int(self.us[-1]), a, b, pause

    def _start(self, state: tuple) -> int:
        return min(int(np.searchsorted(self.top, state[0] + TIMEOUT_US, "right")), self.reopens[state[1]])

    def way_after(self, state: tuple | None, way: int) -> int:
        """Which way the last flow runs (1 from A, 0 from B, -1 unknown), when ``state`` was open before and ran ``way``."""
        start = 0 if state is None else self._start(state)
        if start == self.count:
            return way
        own = int(self.way[start])
        return own if own >= 0 else self.first_way if state is None else way

    def after(self, state: tuple | None) -> tuple:
        """The state after the stretch; without a state, the first packet begins the tuple's first flow."""
        start, number = 0, 0
        if state is not None:
            start = self._start(state)
            if start == self.count:
                opened = int(self.us[0]) if self.us[0] - state[3] > ACTIVITY_US else state[6]
                return self._settled(-1, state[0], state[1], state[2], (state[4], state[5], opened))
            number = state[2] + 1
        row = int(self.last[start])
        return self._settled(row, int(self.us[row]), 0, number + int(self.steps[start]), (NEVER, NEVER, int(self.us[row])))


_FOLDED = ("us", "tcp_flags", "from_a")


def _packets(columns: list[np.ndarray], begins: list[int]) -> Packets:
    us, flags, from_a, known = columns
    return Packets(us.astype(np.int64), flags.astype(np.int64), from_a.astype(bool), np.array(begins, np.int64), known)


def _known(batch: pa.RecordBatch, names: list[str], column: str) -> np.ndarray:
    return batch.column(names.index(column)).is_valid().to_numpy(zero_copy_only=False)


def _numpy(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [*(batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in _FOLDED), _known(batch, names, "from_a")]


def _summaries(names: list[str]):
    """Per stretch the summary of the first tuple's packets and, if another tuple comes after, the last tuple's state at the end."""
    at = [names.index(k) for k in ENDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []
        own: list[list[np.ndarray]] = []
        last, head = None, None

        def summary() -> Summary:
            return Summary(_packets([np.concatenate(c) for c in zip(*own)], [0]))

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(names.index(STRETCH))[0].as_py() if number is None else number
            cuts = [0, *(np.flatnonzero(key_changes(batch, at).to_numpy(zero_copy_only=False)) + 1).tolist()] if batch.num_rows > 1 else [0]
            columns = _numpy(batch, names)
            if last is not None and key_at(batch, at, 0) != last:
                cuts = [0, *cuts]  # the tuple before ends with its batch
            for i, cut in enumerate(cuts):
                if i or last is None:
                    if i and head is None:
                        head = (last, summary())
                    own = [] if i else own
                    last = key_at(batch, at, cut)
                stop = cuts[i + 1] if i + 1 < len(cuts) else batch.num_rows
                if stop > cut:
                    own.append([c[cut:stop] for c in columns])
        if number is None:
            return
        if head is None:
            rows.append((last, "through", pickle.dumps(summary())))
        else:
            rest = summary()
            rows += [(head[0], "head", pickle.dumps(head[1])), (last, "tail", pickle.dumps((rest.after(None), rest.way_after(None, -1))))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([repr(k) for k, _, _ in rows]), pa.array([number] * len(rows), pa.int32()), pa.array([w for _, w, _ in rows]),
             pa.array([pa.compress(c, "zstd", asbytes=True) for _, _, c in rows], pa.binary()), pa.array([len(c) for _, _, c in rows], pa.int64())],
            ["tuple", "stretch", "what", "cell", "size"])

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(tuple, stretch, what, cell, size)`` -> ``(stretch, state)``: what was open, and ran which way, where a tuple goes on
    in a new stretch."""
    tuple_, state, way = None, None, -1
    for batch in batches:
        for key, number, what, cell, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != tuple_:
                tuple_, state, way = key, None, -1
            if what != "tail" and state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((state, way))], pa.binary())], ["stretch", "state"])
            found = pickle.loads(pa.decompress(cell, size, "zstd"))
            state, way = found if what == "tail" else (found.after(state), found.way_after(state, way))


def _spread(p: Packets, state: tuple | None) -> tuple[dict, np.ndarray, tuple]:
    """Per packet its flow's number and its gaps within the flow, whether it begins a flow, and what the last one leaves open."""
    n, jump = p.count, p.nexts()
    starts = np.zeros(n, bool)
    heads = p.begins.copy()
    if state is not None:
        heads[0] = p.entered(state)
    heads = heads[heads < p.ends]
    while len(heads):
        starts[heads] = True
        heads = jump[heads][jump[heads] < p.end[heads]]
    # flows of the batch in order; rows before the first start belong to the open one
    flow = np.cumsum(starts) - 1
    first_flow = flow[p.begins] - starts[p.begins] + 1
    number = flow - first_flow[p.segment]
    if state is not None:
        number[p.segment == 0] += state[2] + 1
    # row of a flow's start, or -1 in the open one; times before a row within its flow, NEVER where there is none
    start = np.where(flow >= 0, np.flatnonzero(starts)[flow] if starts.any() else -1, -1)
    carry = state or (NEVER,) * 7

    def before_row(mask: np.ndarray, old: int) -> np.ndarray:
        rows = np.maximum.accumulate(np.where(mask, np.arange(n), -1))
        rows = np.concatenate([[-1], rows[:-1]])
        inside = rows >= np.maximum(start, 0)
        return np.where(inside & (rows >= 0), p.us[np.maximum(rows, 0)], np.where((start < 0) & ~inside, old, NEVER))

    prev = before_row(np.ones(n, bool), carry[3])
    there = prev != NEVER
    pause = there & (p.us - prev > ACTIVITY_US)
    a, b = before_row(p.from_a, carry[4]), before_row(~p.from_a, carry[5])
    opened = before_row(starts | pause, carry[6])
    gap = p.us - prev
    out = {"flow_no": (number, None), "gap": (np.abs(gap), ~there), "idle": (gap, ~pause),
           "a_gap": (np.abs(p.us - a), ~p.from_a | (a == NEVER)), "b_gap": (np.abs(p.us - b), p.from_a | (b == NEVER)),
           "active": (prev - opened, ~(pause & (opened != NEVER) & (prev > opened)))}
    # what the last tuple's last flow leaves open
    low = p.begins[-1]
    row = max(int(start[-1]), -1)
    own = slice(max(row, low), n)
    old = state if row < 0 else None
    bits = [bool(m[own].any()) for m in (p.fin_a, p.fin_b, p.rst)]
    closing = old[1] if old else 0
    closing = 3 if closing == 3 or bits[2] else closing | bits[0] | bits[1] << 1

    def time_of(mask: np.ndarray, default: int) -> int:
        rows = np.flatnonzero(mask[own])
        return int(p.us[own][rows[-1]]) if len(rows) else default

    left = (old[0] if old else int(p.us[row]), int(closing), int(number[-1]), int(p.us[-1]), time_of(p.from_a, old[4] if old else NEVER),
            time_of(~p.from_a, old[5] if old else NEVER), time_of(starts | pause, old[6] if old else NEVER))
    return out, starts, left


def _ways(p: Packets, cuts: np.ndarray, begins: bool, number: np.ndarray, way: int) -> np.ndarray:
    """a flow opened by a SYN, or the tuple's first, runs the way its first packet does; any other the way of the tuple's flow
    before it, ``way`` in what was open before (there, and where the first flow does not begin at the first row)."""
    own = p.sides(p.syn | (number == 0))[cuts]
    if not begins or own[0] < 0:
        own[0] = way
    segment = p.segment[cuts]
    anchors = (own >= 0) | np.concatenate([[True], segment[1:] != segment[:-1]])
    return own[np.maximum.accumulate(np.where(anchors, np.arange(len(cuts)), 0))]


def _walked(batches: Iterator[pa.RecordBatch], names: list[str], before) -> Iterator[tuple]:
    """Walks a stretch's batches from what ``before`` names for it: yields ``(batch, packets, per packet, starts, cuts, ways, place)``,
    where a batch's share of a flow begins, and which way that flow runs."""
    at = [names.index(k) for k in ENDS]
    last, state, way, place = None, None, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if place is None:
            number = batch.column(names.index(STRETCH))[0].as_py()
            place, cell = number << 40, before.value.get(number)
            state, way = pickle.loads(cell) if cell is not None else (None, -1)
        elif key_at(batch, at, 0) != last:
            state, way = None, -1
        begins = [0, *(np.flatnonzero(key_changes(batch, at).to_numpy(zero_copy_only=False)) + 1).tolist()] if batch.num_rows > 1 else [0]
        p = _packets(_numpy(batch, names), begins)
        out, starts, state = _spread(p, state)
        cuts = np.flatnonzero(np.concatenate([[True], starts[1:]]))
        ways = _ways(p, cuts, bool(starts[0]), out["flow_no"][0], way)
        yield batch, p, out, starts, cuts, ways, place
        way = int(ways[-1])
        last = key_at(batch, at, batch.num_rows - 1)
        place += batch.num_rows


def _numbered(names: list[str], before):
    """Adds to each packet its flow's number, its place, and its gaps within the flow."""
    kept = [i for i, n in enumerate(names) if n != STRETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, out, _, _, _, place in _walked(batches, names, before):
            added = [pa.array(values.astype(np.int64), mask=none) for values, none in out.values()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), *added, pa.array(np.arange(place, place + batch.num_rows), pa.int64())],
                names=[*(names[i] for i in kept), *out, "place"])

    return run


#: a flow's statistics before it is complete: what of it lies in one batch. Moments are (count, sum, sum of squares about the mean)
_MOMENTS = ("gap", "len", "fwd_len", "bwd_len", "fwd_iat", "bwd_iat")
_SUMS = ("pkts", "active_n", "idle_n", *FLAG_COLUMNS.values(), "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes",
         "fwd_hdr", "fwd_rst", "bwd_rst", "fwd_pos")
_LEAST, _MOST = ("gap_min", "len_min", "fwd_hdr_min"), ("gap_max", "len_max")
_TIMES = ("active", "idle")
_PIECE = {"forward_a": "boolean", "whole": "boolean", "place": "bigint", "first_us": "bigint", "last_us": "bigint",
          **dict.fromkeys((*_SUMS, *_LEAST, *_MOST), "bigint"), **dict.fromkeys(_TIMES, "double"), "fwd_first_win": "bigint", "fwd_first_pos": "bigint", "bwd_last_win": "bigint",
          **{f"{m}{part}": kind for m in _MOMENTS for part, kind in (("_k", "bigint"), ("_s", "double"), ("_m2", "double"))}}


class _Cut:
    """Reductions of a batch's rows, flow by flow; a value without rows is masked."""

    def __init__(self, cuts: np.ndarray, count: int):
        self.cuts, self.count = cuts, count
        self.sizes = np.diff(np.append(cuts, count))
        self.of = np.repeat(np.arange(len(cuts)), self.sizes)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.cuts)

    def counted(self, mask: np.ndarray) -> np.ndarray:
        return self.total(mask.astype(np.int64))

    def extreme(self, values: np.ndarray, there: np.ndarray, most: bool = False) -> pa.Array:
        bounds = np.iinfo(np.int64)
        how, rest = (np.maximum, bounds.min) if most else (np.minimum, bounds.max)
        return pa.array(how.reduceat(np.where(there, values, rest), self.cuts), mask=self.counted(there) == 0)

    def moments(self, values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, exact = self.counted(there), np.where(there, values, 0).astype(float)
        s = self.total(exact)
        off = np.where(there, exact - (s / np.maximum(k, 1))[self.of], 0.0)
        return k, s, self.total(off * off)

    def at(self, rows: np.ndarray, found: np.ndarray, values: np.ndarray, there: np.ndarray) -> pa.Array:
        """The values of one row per flow, masked where the flow has none or its value is missing."""
        rows = np.where(found, rows, 0)
        return pa.array(values[rows], mask=~(found & there[rows]))


def _pieces(names: list[str], before, keep_single: bool):
    """Per batch the statistics of each flow's share of it: ``whole`` where that is all of the flow."""
    at = [names.index(k) for k in ENDS]

    def read(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
        values = batch.column(names.index(column))
        return values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), _known(batch, names, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, out, starts, cuts, ways, place in _walked(batches, names, before):
            cut, rows = _Cut(cuts, p.count), np.arange(p.count)
            (us, timed), (pay, sized), (hdr, headed), (win, windowed) = (read(batch, c) for c in ("us", "payload_len", "hdr_len", "tcp_win"))
            flags, tcp = read(batch, "tcp_flags")[0], read(batch, "protocol")[0] == 6
            sides, way = p.sides(), ways[cut.of]
            ends = cuts + cut.sizes - 1
            whole = np.ones(len(cuts), bool)
            whole[0], whole[-1] = whole[0] and starts[0], False
            data = {"forward_a": pa.array(ways == 1, mask=ways < 0), "whole": whole, "place": place + cuts,
                    "first_us": pa.array(us[cuts], mask=~timed[cuts]), "last_us": pa.array(us[ends], mask=~timed[ends]), "pkts": cut.sizes}
            gaps = {c: (values, ~none) for c, (values, none) in out.items() if c != "flow_no"}
            gap, gapped = gaps["gap"]
            data |= {"gap_min": cut.extreme(gap, gapped), "gap_max": cut.extreme(gap, gapped, True),
                     "len_min": cut.extreme(pay, sized), "len_max": cut.extreme(pay, sized, True)}
            for c in _TIMES:
                values, there = gaps[c]
                data |= {f"{c}_n": cut.counted(there), c: cut.total(np.where(there, values, 0).astype(float))}
            data |= {name: cut.counted(tcp & (flags & bit > 0)) for bit, name in FLAG_COLUMNS.items()}
            moments = {"gap": (gap, gapped), "len": (pay, sized)}
            for end, a in (("fwd", way == 1), ("bwd", way == 0)):
                # this side's packets; where no packet told a flow's way, both sides are end B's
                mine = sides == np.where(a, 1, 0)
                counted = cut.counted(mine)
                data |= {f"{end}_pkts": counted, f"{end}_rst": cut.counted(mine & tcp & (flags & RST > 0)),
                         f"{end}_bytes": pa.array(cut.total(np.where(mine, pay, 0)), mask=cut.counted(~mine | sized) == 0)}
                moments[f"{end}_len"] = (pay, mine & sized)
                moments[f"{end}_iat"] = tuple(np.where(a, x, y) for x, y in zip(gaps["a_gap"], gaps["b_gap"]))
                if end == "bwd":
                    latest = np.maximum.reduceat(np.where(mine, rows, -1), cuts)
                    data["bwd_last_win"] = cut.at(latest, counted > 0, win, tcp & windowed)
                    continue
                earliest = np.minimum.reduceat(np.where(mine, rows, p.count), cuts)
                data |= {"fwd_first_win": cut.at(earliest, counted > 0, win, tcp & windowed),
                         "fwd_first_pos": cut.at(earliest, counted > 0, (pay > 0).astype(np.int64), sized), "fwd_pos": cut.counted(mine & (pay > 0)),
                         "fwd_hdr": pa.array(cut.total(np.where(mine, hdr, 0)), mask=cut.counted(~mine | headed) == 0),
                         "fwd_hdr_min": cut.extreme(hdr, mine & headed)}
            for name, (values, there) in moments.items():
                data |= dict(zip((f"{name}_k", f"{name}_s", f"{name}_m2"), cut.moments(values, there)))
            keep = np.flatnonzero(np.ones(len(cuts), bool) if keep_single else ~whole | (cut.sizes > 1))
            if len(keep):
                taken, own = pa.array(cuts[keep]), pa.array(keep)
                columns = [batch.column(i).take(taken) for i in at] + [pa.array(out["flow_no"][0]).take(taken)]
                columns += [(c if isinstance(c := data[n], pa.Array) else pa.array(c)).take(own) for n in _PIECE]
                yield pa.RecordBatch.from_arrays(columns, names=[*ENDS, "flow_no", *_PIECE])

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Flows from pieces of flows: counts add up, and squares about each piece's mean are moved to the flow's."""
    flow = [*ENDS, "flow_no"]
    whole = Window.partitionBy(*flow)
    place = F.col("place")
    moved = {}
    for m in _MOMENTS:
        k, s = F.col(f"{m}_k"), F.col(f"{m}_s")
        off = F.try_divide(s, k) - F.try_divide(F.sum(s).over(whole), F.sum(k).over(whole))
        moved[f"{m}_m2"] = F.col(f"{m}_m2") + F.coalesce(k * off * off, F.lit(0.0))
    forward, backward = (F.when(F.col(f"{end}_pkts") > 0, place) for end in ("fwd", "bwd"))
    aggs = {"forward_a": F.max("forward_a"), "whole": F.lit(True), "place": F.min("place"),
            "first_us": F.min_by("first_us", place), "last_us": F.max_by("last_us", place), **{c: F.sum(c) for c in (*_SUMS, *_TIMES)},
            **{c: F.min(c) for c in _LEAST}, **{c: F.max(c) for c in _MOST},
            "fwd_first_win": F.min_by("fwd_first_win", forward), "fwd_first_pos": F.min_by("fwd_first_pos", forward),
            "bwd_last_win": F.max_by("bwd_last_win", backward),
            **{f"{m}{part}": F.sum(f"{m}{part}") for m in _MOMENTS for part in ("_k", "_s", "_m2")}}
    return pieces.withColumns(moved).groupBy(*flow).agg(*(aggs[c].alias(c) for c in _PIECE))


def _sorted_packets(packets: DataFrame, kept: list[str]) -> tuple[DataFrame, Broadcast]:
    """Packets dealt once, by ranges of (tuple, order), with the columns ``kept``; and what is open where a tuple crosses a border."""
    flags = F.when(F.col("protocol") == 6, F.coalesce("tcp_flags", F.lit(0))).otherwise(F.lit(0))
    ready = with_ends(flow_packets(packets)).withColumn("tcp_flags", flags).withColumn("us", F.unix_micros("ts"))
    ready = dealt(ready.select(*dict.fromkeys([*ENDS, *ORDER, *kept])), ENDS, ORDER, kept)
    cells = ready.mapInArrow(_summaries(ready.columns), "tuple string, stretch int, what string, cell binary, size bigint")
    # one row or two per stretch; a tuple within one stretch needs nothing
    cells = cells.repartition("tuple").sortWithinPartitions("tuple", "stretch")
    found = cells.mapInArrow(_chained, "stretch int, state binary").collect()
    return ready, packets.sparkSession.sparkContext.broadcast({r.stretch: bytes(r.state) for r in found})


_READ = ["us", "from_a", "tcp_flags", "payload_len", "hdr_len", "tcp_win"]


def assign_flows(packets: DataFrame) -> DataFrame:
    """F1: every packet with its flow: adds ``flow_no`` (from 0 in a tuple), ``place`` (ascending along the tuple) and, in microseconds
    within the flow, the gap to the packet before, from the same end, pauses, and the active time a pause ends.

    Packets are dealt once, by ranges of (tuple, order), so a tuple that never pauses spreads over as many tasks as it has
    stretches. Where it crosses a border, the flow that is open there comes from chaining the summaries of its stretches.
    """
    ready, before = _sorted_packets(packets, [*ENDS, *ORDER, *_READ])
    times = ("flow_no", "gap", "idle", "a_gap", "b_gap", "active", "place")
    schema = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes if n != STRETCH) + "".join(f", {c} bigint" for c in times)
    return ready.mapInArrow(_numbered(ready.columns, before), schema)


def assemble_flows(packets: DataFrame, keep_single: bool = False) -> DataFrame:
    """Canonical flows (without label columns), packet-stat columns included; times in microseconds.

    Packets lie in the order of their flows, so a flow's statistics, and the way it runs, are taken in passing: no packet is
    shuffled again, and a flow of one packet goes no further. What a batch's ends cut through is kept as pieces, a row or two
    per batch; these alone are grouped. Flows are written once, as the pieces, and can be read many times.
    """
    ready, before = _sorted_packets(packets, [*ENDS, *_READ])
    schema = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes if n in ENDS) + ", flow_no bigint" + "".join(f", {n} {t}" for n, t in _PIECE.items())
    pieces = cut_lineage(ready.mapInArrow(_pieces(ready.columns, before, keep_single), schema))
    del ready
    let_go(packets.sparkSession)
    cut = cut_lineage(_joined(pieces.where(~F.col("whole"))))
    flows = pieces.where("whole").unionByName(cut)
    if not keep_single:
        flows = flows.where(F.col("pkts") >= 2)

    def ends(kind: str, forward: bool) -> Column:
        return F.when(F.col("forward_a") == F.lit(forward), F.col(f"{kind}_a")).otherwise(F.col(f"{kind}_b"))

    def num(c: Column) -> Column:
        return zero_if_null(c.cast("double"))

    def mean(total: str, count: str) -> Column:
        return num(F.try_divide(F.col(total), F.col(count)))

    def deviation(m: str) -> Column:
        return num(F.when(F.col(f"{m}_k") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col(f"{m}_k") - 1))))

    def whole(c: str) -> Column:
        return F.coalesce(c, F.lit(0)).cast("long")

    forward, backward = F.col("fwd_pkts"), F.col("bwd_pkts")
    return flows.select(
        "split", F.timestamp_micros("first_us").alias("ts"), ends("ip", True).alias("src_ip"), ends("port", True).alias("src_port"),
        ends("ip", False).alias("dst_ip"), ends("port", False).alias("dst_port"), "protocol",
        (F.col("last_us") - F.col("first_us")).cast("double").alias("duration_us"),
        "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes",
        mean("gap_s", "gap_k").alias("flow_iat_mean"), deviation("gap").alias("flow_iat_std"),
        num(F.col("gap_max")).alias("flow_iat_max"), num(F.col("gap_min")).alias("flow_iat_min"),
        *(F.col(FLAG_COLUMNS[b]) for b in (FIN, SYN, RST, PSH, ACK, URG, CWR, ECE)),
        num(F.col("len_min")).alias("pkt_len_min"), num(F.col("len_max")).alias("pkt_len_max"),
        mean("len_s", "len_k").alias("pkt_len_mean"), deviation("len").alias("pkt_len_std"),
        F.when(forward > 0, backward / forward).otherwise(F.lit(0.0)).alias("down_up_ratio"),
        whole("fwd_first_win").alias("fwd_init_win"), whole("bwd_last_win").alias("bwd_init_win"),
        whole("fwd_hdr_min").alias("fwd_seg_size_min"), mean("active", "active_n").alias("active_mean"), mean("idle", "idle_n").alias("idle_mean"),
        deviation("fwd_len").alias("fwd_pkt_len_std"), deviation("bwd_len").alias("bwd_pkt_len_std"),
        deviation("fwd_iat").alias("fwd_iat_std"), deviation("bwd_iat").alias("bwd_iat_std"),
        "fwd_rst", "bwd_rst", F.col("fwd_hdr").alias("fwd_hdr_bytes"),
        (F.col("fwd_pos") - F.coalesce("fwd_first_pos", F.lit(0))).alias("fwd_data_pkts")).withColumnsRenamed(
        {"fwd_rst": "fwd_rst_cnt", "bwd_rst": "bwd_rst_cnt"})


SESSION = ["split", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def payload_buckets() -> dict[str, Column]:
    """F4's payload sizes, each as a test on a packet."""
    pay = F.col("payload_len")
    return {"payload_0_64": pay <= 64, "payload_65_128": (pay > 64) & (pay <= 128), "payload_129_512": (pay > 128) & (pay <= 512),
            "payload_513_1024": (pay > 512) & (pay <= 1024), "payload_gt_1024": pay > 1024}


def session_packet_stats(packets: DataFrame) -> DataFrame:
    """per directed 5-tuple: packets, TTL mean and population variance, windows, fragments, back-to-back
    equal sequence numbers, payload buckets.

    The repeated-sequence test looks one packet back inside 120 s blocks, and a block's first packet at the
    last of the block before, from a summary; so a long session is many small sorts.
    """
    rows = flow_packets(packets).withColumn("block", _div(F.unix_micros("ts"), TIMEOUT_US))
    order = F.struct(*ORDER)
    inside = Window.partitionBy(*SESSION, "block").orderBy(*ORDER)
    tcp, buckets = F.col("protocol") == 6, payload_buckets()
    rows = rows.withColumn("repeat", (tcp & (F.lag("seq").over(inside) == F.col("seq"))).cast("int"))
    per_block = rows.groupBy(*SESSION, "block").agg(
        F.count("*").alias("n"), F.sum("ttl").alias("t1"), F.sum(F.col("ttl") * F.col("ttl")).alias("t2"),
        F.sum(F.when(tcp, F.col("tcp_win"))).alias("w1"), F.max(F.when(tcp, F.col("tcp_win"))).alias("wmax"),
        F.count_if(F.col("more_frags") | (F.col("frag_off") > 0)).alias("frags"), F.sum("repeat").alias("repeats"),
        F.min_by("seq", order).alias("first_seq"), F.max_by("seq", order).alias("last_seq"),
        *(F.count_if(test).alias(name) for name, test in buckets.items()))
    along = Window.partitionBy(*SESSION).orderBy("block")
    joint = (tcp & (F.lag("last_seq").over(along) == F.col("first_seq"))).cast("int")
    n = F.sum("n")
    mean = F.sum("t1") / n
    return per_block.withColumn("joint", joint).groupBy(*SESSION).agg(
        n.alias("packet_count"), mean.alias("ttl_mean"), F.greatest(F.sum("t2") / n - mean * mean, F.lit(0.0)).alias("ttl_variance"),
        zero_if_null(F.sum("w1") / n).alias("tcp_win_mean"), zero_if_null(F.max("wmax").cast("double")).alias("tcp_win_max"),
        F.sum("frags").alias("ip_frag_count"), (F.sum(F.coalesce("repeats", F.lit(0))) + F.sum(F.coalesce("joint", F.lit(0)))).alias("retrans_count"),
        *(F.sum(name).alias(name) for name in buckets))


def port_scan_signatures(packets: DataFrame, keep: int = 100) -> DataFrame:
    """a verdict per source from its last ``keep`` destination ports.

    The last ``keep`` packets per source are a ranked limit per group, which Spark prunes inside each task
    before the shuffle, so a source with most of the packets still ships at most ``keep`` rows per task.
    """
    recent = Window.partitionBy("split", "src_ip").orderBy(*(F.desc(c) for c in ORDER))
    last = (flow_packets(packets).select("split", "src_ip", "dst_port", *ORDER)
            .withColumn("back", F.row_number().over(recent)).where(F.col("back") <= keep))
    order = Window.partitionBy("split", "src_ip").orderBy(F.desc("back"))
    moved = last.withColumn("moved", F.coalesce(F.col("dst_port") != F.lag("dst_port").over(order), F.lit(True)))
    steps = moved.where("moved").withColumn("step", F.abs(F.col("dst_port") - F.lag("dst_port").over(order)))
    sizes = last.groupBy("split", "src_ip").agg(F.count("*").alias("seen"), F.count_distinct("dst_port").alias("ports"))
    walk = steps.groupBy("split", "src_ip").agg(
        F.count("*").alias("moves"), F.try_divide(F.count_if(F.col("step") == 1), F.count("step")).alias("ratio"))
    verdict = (F.when((F.col("seen") < 15) | (F.col("moves") < 5), "benign").when(F.col("ratio") > 0.6, "sequential_scan")
               .when((F.col("ratio") < 0.1) & (F.col("ports") > 10), "randomised_scan").otherwise("benign"))
    return sizes.join(walk, ["split", "src_ip"]).select("split", "src_ip", verdict.alias("signature"))
