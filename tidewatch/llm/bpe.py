"""Byte-level BPE by a lazily determinised transducer, and streaming decoding with an incremental UTF-8 machine.

**Encoding.** The merges of a rank file become a transducer over bytes. Its nondeterministic states are
``(last closed token, open trie node)``; a token may close where the merges would not have joined it with the token
before it. Whether they would follows from the two tokens alone: along the right edge of the first and the left edge of
the second, no pair may have a rank below the ranks at which its halves are used up. A sequence whose neighbours all
pass is the one the merges produce, so every text has exactly one path. Deterministic states (sets of hypotheses) and
their transitions, which tell where each hypothesis comes from and which token it closed, are made when a text first
needs them. Open tokens are bounded by the longest token, so hypotheses soon agree on what lies behind; settled tokens
then leave.

**Decoding.** Token bytes are streamed in chunks; the machine holds back the bytes of a character that a chunk has begun
and not finished, so everything emitted ends at a character.

Texts are rows: nothing is shuffled or collected. The rank file is read by the driver and broadcast (a vocabulary, not
data, bounds its size); caches of states and pieces are dropped when full, which changes no result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import held_by, without_collector
from tidewatch.llm.remembered import Remembered

NEVER = 1 << 60
NODE_BITS, START = 24, 1 << 30
NODE_MASK = (1 << NODE_BITS) - 1
STATES_MOST = 400_000
PIECES_MOST = 350_000
#: bytes after which settled tokens are let out; open ones are bounded by the longest token
LOOKAHEAD = 64
PAIRS_MOST = 300_000
#: moves that long pieces, walked alone, remember by key
WALKED_MOST = 1 << 17
CHUNK = 4096
#: pieces that go through the transducer in step, and characters whose pieces are looked up together
STEP, TEXT = 16_384, 1 << 20
#: pieces of one longer text that are looked up together
PART = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """BPE of single pieces; ``encode`` gives what repeated merging of the lowest-ranked pair gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.step_of: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                node = self.step_of.get(key, 0)
                if not node:
                    node = self.step_of[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}  # left << 32 | right
        self._forget()

    def _forget(self) -> None:
        # a state is the bytes of its hypotheses, 64 bits each
        self.states: list[bytes] = [array("q", [START << NODE_BITS]).tobytes()]
        self.number: dict[bytes, int] = {self.states[0]: 0}
        self.ends: dict[int, tuple[int, int]] = {}
        # moves as columns; their numbers by key (state * 256 + byte): in order as far as they have been sorted, else in ``fresh``
        self.moves, self.fresh = 0, {}
        self.walked: dict[int, int] = {}
        self.columns = np.zeros((5, 1024), np.int32)  # next state, begun, source, closed, where its sources lie
        self.sources, self.used = np.zeros(4096, np.int32), 0
        self.sorted = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; ``(-1, -1)`` for a byte, None where merging never reaches it."""
        if token in self.halves:
            return self.halves[token]
        whole = self.bytes_of[token]
        parts = [whole[i:i + 1] for i in range(len(whole))]
        result: tuple[int, int] | None = (-1, -1)
        while len(parts) > 1:
            at = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            least = min(at)
            if least == NEVER:
                result = None
                break
            i = at.index(least)
            if len(parts) == 2:
                result = (self.ranks[parts[0]], self.ranks[parts[1]])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        self.halves[token] = result
        return result

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """From the outermost byte to ``token``: each token on that side and the rank at which it is used up."""
        found = self.edges[side].get(token)
        if found is None:
            found, used, at = [], NEVER, token
            while at >= 0:
                found.append((self.bytes_of[at], used))
                used, at = at, self.split(at)[side]
            found.reverse()
            self.edges[side][token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are when they stand side by side."""
        known = self.pairs.get(left << 32 | right)
        if known is not None:
            return known
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            rank = self.ranks.get(x + y, NEVER)
            # of equal ranks the leftmost pair merges first
            if rank < x_used and rank <= y_used:
                answer = False
                break
            if x_used == y_used == NEVER:
                answer = True
                break
            if x_used <= y_used:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS_MOST:
            self.pairs.clear()
        self.pairs[left << 32 | right] = answer
        return answer

    def _closes(self, hypothesis: int) -> int:
        """The token that may close here, or -1."""
        token = self.token_at[hypothesis & NODE_MASK]
        if token < 0 or self.split(token) is None:
            return -1
        last = hypothesis >> NODE_BITS
        return token if last == START or self.apart(last, token) else -1

    def _move(self, state: int, byte: int) -> int:
        """The number of a new move: next state, source of each hypothesis that goes on, index of the one that begins, its
        source, closed token."""
        after, sources, begun, source, closed = [], [], -1, -1, -1
        step_of = self.step_of
        for i, hypothesis in enumerate(array("q", self.states[state])):
            child = step_of.get((hypothesis & NODE_MASK) << 8 | byte)
            if child:
                after.append(hypothesis & ~NODE_MASK | child)
                sources.append(i)
            if closed < 0:  # a prefix has one tokenisation, so at most one may close
                closed = self._closes(hypothesis)
                source = i
        if closed >= 0:
            begun = len(after)
            after.append(closed << NODE_BITS | step_of[byte])
        new = array("q", after).tobytes()
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        place = self.fresh[state << 8 | byte] = self.moves
        self.moves += 1
        if place == self.columns.shape[1]:
            self.columns = np.concatenate([self.columns, np.zeros((5, place // 2), np.int32)], axis=1)
        if self.used + len(sources) >= len(self.sources):
            self.sources = np.concatenate([self.sources, np.zeros(len(self.sources) // 2 + len(sources), np.int32)])
        self.columns[:, place] = (at, begun, source, closed, self.used)
        self.sources[self.used:self.used + len(sources)] = sources
        self.used += len(sources)
        return place

    def _moves_of(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the moves with these keys (state * 256 + byte); those not met before are made."""
        fresh = self.fresh
        if len(fresh) > max(2048, len(self.sorted[0]) // 16) or not len(self.sorted[0]):
            if not fresh:
                self._move(int(keys[0]) >> 8, int(keys[0]) & 255)
            known = np.concatenate([self.sorted[0], np.fromiter(fresh.keys(), np.int64, len(fresh))])
            order = np.argsort(known, kind="stable")
            self.sorted = known[order], np.concatenate([self.sorted[1], np.fromiter(fresh.values(), np.int32, len(fresh))])[order]
            fresh.clear()
        known, numbers = self.sorted
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = numbers[at]
        new = np.flatnonzero(known[at] != keys)
        if len(new):
            missing, where = np.unique(keys[new], return_inverse=True)
            for key in missing.tolist():
                if key not in fresh:
                    self._move(key >> 8, key & 255)
            out[new] = np.array([fresh[key] for key in missing.tolist()], np.int32)[where]
        return out

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; short pieces go through the transducer in step."""
        out = [b""] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LOOKAHEAD:
                out[i] = array("i", self.encode(piece)).tobytes()
            elif piece:
                short.append(i)
        short.sort(key=lambda i: -len(pieces[i]))
        for a in range(0, len(short), STEP):
            part = short[a:a + STEP]
            for i, ids in zip(part, self._in_step([pieces[i] for i in part])):
                out[i] = ids
        return out

    def _in_step(self, pieces: list[bytes]) -> list[bytes]:
        """``encode`` of pieces that grow no longer, a byte of all of them at a time."""
        if len(self.states) > STATES_MOST:
            self._forget()
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths[0])
        body = np.zeros((n, width), np.int64)
        body[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        live = [int(np.searchsorted(-lengths, -j, "left")) for j in range(width)]  # pieces longer than j
        state, taken = np.zeros(n, np.int64), []
        for j in range(width):
            moves = self._moves_of(state[:live[j]] << 8 | body[:live[j], j])
            state[:live[j]] = self.columns[0][moves]
            taken.append(moves)
        (_, begun, source, closed, first), sources = self.columns, self.sources
        lasts, where = np.unique(state, return_inverse=True)
        ends = np.array([self.ends.get(s) or self._end(s) for s in lasts.tolist()], np.int64)[where]
        at, tokens = ends[:, 0].copy(), np.full((n, width + 1), -1, np.int32)
        tokens[np.arange(n), lengths] = ends[:, 1]
        for j in range(width - 1, -1, -1):
            moves, own = taken[j], at[:live[j]]
            closes = own == begun[moves]
            rows = np.flatnonzero(closes)
            tokens[rows, j] = closed[moves[rows]]
            at[:live[j]] = np.where(closes, source[moves], sources[first[moves] + np.where(closes, 0, own)])
        there = tokens >= 0
        cut = np.concatenate([[0], np.cumsum(there.sum(axis=1))]) * 4
        ids = tokens[there].astype("<i4").tobytes()
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def _end(self, state: int) -> tuple[int, int]:
        """The hypothesis that ends the text here, and its last token."""
        for i, hypothesis in enumerate(array("q", self.states[state])):
            token = self._closes(hypothesis)
            if token >= 0:
                self.ends[state] = i, token
                return i, token
        raise ValueError("no token sequence fits; the vocabulary lacks single bytes")

    def _closed(self, path: list[int], at: int, out: list[int]) -> None:
        """The tokens closed along the moves ``path`` by hypothesis ``at`` of its last state, in reverse."""
        for place in reversed(path):
            _, begun, source, token, first = self.columns[:, place].tolist()
            if at == begun:
                out.append(token)
                at = source
            else:
                at = int(self.sources[first + at])

    def _walk(self, key: int) -> int:
        """The number of the move with this key, made if it was not met before."""
        place = self.fresh.get(key)
        if place is None:
            known, numbers = self.sorted
            at = int(np.searchsorted(known, key))
            place = int(numbers[at]) if at < len(known) and known[at] == key else self._move(key >> 8, key & 255)
        if len(self.walked) >= WALKED_MOST:
            self.walked.clear()
        self.walked[key] = place
        return place

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if not piece:
            return ()
        if len(self.states) > STATES_MOST:
            self._forget()
        state, path, walked, done = 0, [], self.walked, []
        for byte in piece:
            place = walked.get(state << 8 | byte)
            if place is None:
                place = self._walk(state << 8 | byte)
            path.append(place)
            state = int(self.columns[0, place])
            if len(path) > LOOKAHEAD and len(self.states[state]) == 8:
                # one hypothesis is left: everything behind it is settled and leaves
                ready: list[int] = []
                self._closed(path, 0, ready)
                done += reversed(ready)
                path.clear()
                if len(self.states) > 2 * STATES_MOST:  # one very long piece
                    now = self.states[state]
                    self._forget()
                    walked, state = self.walked, 1
                    self.states.append(now)
                    self.number[now] = 1
        at, token = self.ends.get(state) or self._end(state)
        out = [token]
        self._closed(path, at, out)
        return (*done, *reversed(out))


class Encoder(Remembered):
    """Whole texts: every match of the pattern goes through the transducer; recent words and pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = PIECES_MOST):
        self.fst = Transducer(ranks)
        super().__init__(pattern, lambda pieces: self.fst.encode_many([p.encode() for p in pieces]), most)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; the pieces that are new in some texts go through the transducer together."""
        out, start = [], 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= TEXT):
                size += len(texts[stop] or "")
                stop += 1
            if size > TEXT:  # one long text: its pieces come in parts
                matches = self.pattern.finditer(texts[start])
                parts = iter(lambda: [m.group() for m in islice(matches, PART)], [])
                out.append(b"".join(self.of_pieces([part])[0] for part in parts))
            else:
                out += self.of_texts([t or "" for t in texts[start:stop]])
            start = stop
        return out


#: UTF-8 machine: state = bytes still missing, with the four states whose next byte is restricted
DONE, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BAD = range(9)


def _utf8_table() -> np.ndarray:
    t = np.full((9, 256), BAD, np.uint8)
    t[DONE, :0x80] = DONE
    t[DONE, 0xC2:0xE0], t[DONE, 0xE1:0xF0], t[DONE, 0xF1:0xF4] = ONE, TWO, THREE
    t[DONE, 0xE0], t[DONE, 0xED], t[DONE, 0xF0], t[DONE, 0xF4] = AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4
    t[ONE, 0x80:0xC0], t[TWO, 0x80:0xC0], t[THREE, 0x80:0xC0] = DONE, ONE, TWO
    t[AFTER_E0, 0xA0:0xC0], t[AFTER_ED, 0x80:0xA0] = ONE, ONE
    t[AFTER_F0, 0x90:0xC0], t[AFTER_F4, 0x80:0x90] = TWO, TWO
    return t


UTF8 = _utf8_table().tolist()


class StreamDecoder:
    """Feed token ids, get bytes that end at a character; ``close`` gives what an unfinished text left."""

    def __init__(self, bytes_of: Callable[[int], bytes]):
        self.bytes_of, self.held = bytes_of, b""

    def feed(self, ids) -> bytes:
        body = self.held + b"".join(map(self.bytes_of, ids))
        # a character has at most four bytes, so the machine needs to run from the last lead byte only
        start = len(body)
        for back in range(1, min(4, len(body)) + 1):
            if body[-back] & 0xC0 != 0x80:
                start = len(body) - back
                break
        state = DONE
        for b in body[start:]:
            state = UTF8[state][b]
        cut = len(body) if state in (DONE, BAD) else start
        self.held = body[cut:]
        return body[:cut]

    def close(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


def _once(kind: str, key: str, make: Callable[[], object]):
    """One object of each kind per worker process, made anew for another key."""
    kept = held_by("bpe")
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = key, make()
    return kept[kind][1]


def codec(spark: SparkSession, rank_file: str, pattern: str, most: int = PIECES_MOST) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """``(encode, decode)``: column functions from text to ``array<int>`` and from that to binary.

    A null or empty text has no ids, and no ids are the empty binary. Ids that the vocabulary lacks raise. A worker
    remembers up to twice ``most`` pieces: fewer cost time, more cost memory.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))
    key = f"{spark.sparkContext.applicationId}/{rank_file}/{pattern}/{most}"

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = _once("encoder", key, lambda: Encoder(ranks.value, pattern, most))
        with without_collector():
            rows = encoder.encode_batch(texts.to_pylist())
        ends = np.cumsum([0, *map(len, rows)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        bytes_of = _once("bytes", key, lambda: {rank: token for token, rank in ranks.value.items()}).__getitem__
        ids, ends, there = rows.values.to_numpy(), rows.offsets.to_numpy(), rows.is_valid().to_pylist()
        out = []
        for i, valid in enumerate(there):
            stream = StreamDecoder(bytes_of)
            parts = [stream.feed(ids[a:min(a + CHUNK, ends[i + 1])].tolist()) for a in range(ends[i], ends[i + 1], CHUNK)] if valid else []
            out.append(b"".join([*parts, stream.close()]))
        return pa.array(out, pa.binary())

    return lambda text: encode(text.cast("string")), decode


def encoded(docs: DataFrame, rank_file: str, pattern: str, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in an array column ``name``; other columns pass through."""
    encode, _ = codec(docs.sparkSession, rank_file, pattern)
    return docs.withColumn(name, encode(F.col("text")))


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row of ``docs(doc_id, text, ...)``: the ids, and their bytes streamed back."""
    encode, decode = codec(docs.sparkSession, rank_file, pattern)
    return docs.select("doc_id", encode(F.col("text")).alias("ids")).withColumn("decoded", decode(F.col("ids")))
