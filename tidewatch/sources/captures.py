"""Packet captures as a Spark data source (``spark.read.format("capture").load(folder)``).

One input partition per capture file; a task reads its file forward in chunks and yields Arrow batches, so
memory does not grow with the file. Classic pcap and pcapng, both byte orders, micro- and nanosecond ticks,
VLAN tags, raw-IP and Linux cooked links. Frames that hold no IPv4 packet come back as rows with
``skipped = true``, so the manifest can count them.
"""

from __future__ import annotations

import glob
import hashlib
import os
import struct
import sys
from collections import deque
from typing import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.schema import PACKET_SCHEMA

# The process that plans a Python source does not see files added to the application: the source travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 20_000
CHUNK = 1 << 22
# --- fixed values: file magic -> (byte order, ticks per second); link types; ether types -----------------
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6),
           b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NG_SECTION, NG_INTERFACE, NG_ENHANCED = 0x0A0D0D0A, 1, 6
NG_LITTLE = b"\x4d\x3c\x2b\x1a"
OPT_END, OPT_TSRESOL = 0, 9
LINK_ETHERNET, LINK_COOKED, LINKS_RAW = 1, 113, (12, 14, 101, 228)
ETHER_IPV4, ETHER_VLANS = 0x0800, (0x8100, 0x88A8)
TCP, UDP = 6, 17


class Forward:
    """A file read strictly forward, a chunk at a time."""

    def __init__(self, fh) -> None:
        self.fh, self.rest = fh, b""

    def take(self, size: int) -> bytes | None:
        """The next ``size`` bytes, or None when the file ends first."""
        if len(self.rest) < size:
            parts, have = [self.rest], len(self.rest)
            while have < size:
                more = self.fh.read(max(CHUNK, size - have))
                if not more:
                    return None
                parts.append(more)
                have += len(more)
            self.rest = b"".join(parts)
        out, self.rest = self.rest[:size], self.rest[size:]
        return out


def classic_frames(src: Forward, order: str, ticks: int) -> Iterator[tuple[int, int, bytes]]:
    """(time in microseconds, link type, frame) of a classic capture whose magic was already read."""
    head = src.take(20)
    if head is None:
        return
    link = struct.unpack(order + "I", head[16:20])[0]
    while (record := src.take(16)) is not None:
        seconds, part, size, _ = struct.unpack(order + "IIII", record)
        frame = src.take(size)
        if frame is None:
            return
        yield seconds * 10**6 + part * 10**6 // ticks, link, frame


def _resolution(options: bytes, order: str) -> int:
    """Ticks per second from an interface's options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == OPT_END:
            break
        if code == OPT_TSRESOL and size:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + size + (-size % 4)
    return 10**6


def ng_frames(src: Forward, name: str) -> Iterator[tuple[int, int, bytes]]:
    """(time in microseconds, link type, frame) of a pcapng capture whose first four bytes were already read."""
    order, links, kind_bytes = "<", [], struct.pack("<I", NG_SECTION)
    while kind_bytes is not None:
        size_bytes = src.take(4)
        if size_bytes is None:
            return
        peeked = b""
        if kind_bytes == struct.pack("<I", NG_SECTION):  # reads the same in both byte orders
            peeked = src.take(4)
            if peeked is None:
                return
            order, links = ("<" if peeked == NG_LITTLE else ">"), []
        kind = struct.unpack(order + "I", kind_bytes)[0]
        size = struct.unpack(order + "I", size_bytes)[0]
        if size < 12 or size % 4:
            raise ValueError(f"{name}: corrupt pcapng block (type {kind:#x}, length {size})")
        rest = src.take(size - 8 - len(peeked))
        if rest is None:
            return
        body = (peeked + rest)[:-4]
        if kind == NG_INTERFACE:
            links.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif kind == NG_ENHANCED:
            port, high, low, stored = struct.unpack_from(order + "IIII", body)
            link, ticks = links[port]
            yield (high << 32 | low) * 10**6 // ticks, link, body[20:20 + stored]
        kind_bytes = src.take(4)


def frames(fh, name: str) -> Iterator[tuple[int, int, bytes]]:
    src = Forward(fh)
    magic = src.take(4)
    if magic in CLASSIC:
        yield from classic_frames(src, *CLASSIC[magic])
    elif magic == struct.pack("<I", NG_SECTION):
        yield from ng_frames(src, name)
    else:
        raise ValueError(f"{name}: neither pcap nor pcapng")


def ipv4_of(frame: bytes, link: int) -> bytes | None:
    """The IPv4 packet inside a frame, or None."""
    if link == LINK_ETHERNET:
        at = 12
        while len(frame) >= at + 2 and int.from_bytes(frame[at:at + 2], "big") in ETHER_VLANS:
            at += 4
        packet = frame[at + 2:] if int.from_bytes(frame[at:at + 2], "big") == ETHER_IPV4 else b""
    elif link in LINKS_RAW:
        packet = frame
    elif link == LINK_COOKED:
        packet = frame[16:] if int.from_bytes(frame[14:16], "big") == ETHER_IPV4 else b""
    else:
        packet = b""
    return packet if len(packet) >= 20 and packet[0] >> 4 == 4 else None


def packet_fields(packet: bytes) -> dict:
    """Header fields of an IPv4 packet; transport fields stay null where the packet does not carry them."""
    header = (packet[0] & 15) * 4
    total, _, fragment, ttl, protocol = struct.unpack_from("!HHHBB", packet, 2)
    offset = fragment & 0x1FFF
    out = {"src_ip": ".".join(map(str, packet[12:16])), "dst_ip": ".".join(map(str, packet[16:20])), "protocol": protocol,
           "ttl": ttl, "more_frags": bool(fragment & 0x2000), "frag_off": offset, "payload_len": max(0, total - header)}
    if offset:  # a later fragment starts with payload, not with a transport header
        return out
    if protocol == TCP and len(packet) >= header + 16:
        sport, dport, seq, _, words, flags, window = struct.unpack_from("!HHIIBBH", packet, header)
        size = (words >> 4) * 4
        out.update(src_port=sport, dst_port=dport, seq=seq, tcp_flags=flags, tcp_win=window, hdr_len=size,
                   payload_len=max(0, total - header - size))
    elif protocol == UDP and len(packet) >= header + 8:
        # the datagram's own length: of a fragmented one, the first packet stands for the whole
        sport, dport, size = struct.unpack_from("!HHH", packet, header)
        out.update(src_port=sport, dst_port=dport, tcp_flags=0, hdr_len=8, payload_len=max(0, size - 8))
    return out


class CaptureFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        path = options.get("path", "")
        found = sorted(glob.glob(os.path.join(path, "*.pcap*")) if os.path.isdir(path) else glob.glob(path))
        if not found:
            raise ValueError(f"no capture files at {path!r}")
        self.files = found
        self.split = options.get("split")
        self.recent = int(options.get("dedupe", "0"))

    def partitions(self):
        return [CaptureFile(f) for f in self.files]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(PACKET_SCHEMA)
        name = os.path.basename(partition.path)
        split = self.split or name.split(".")[0]
        recent: deque = deque(maxlen=self.recent or None)
        rows: list[dict] = []
        with open(partition.path, "rb") as fh:
            for number, (us, link, frame) in enumerate(frames(fh, name)):
                packet = ipv4_of(frame, link)
                row = {"split": split, "capture": name, "frame_no": number, "ts": us, "skipped": packet is None}
                if packet is not None:
                    digest = hashlib.blake2b(packet, digest_size=16).digest()
                    if self.recent:  # exact duplicate removal while the file is read in order
                        if digest in recent:
                            continue
                        recent.append(digest)
                    row |= packet_fields(packet) | {"ip_digest": digest}
                rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


class CaptureSource(DataSource):
    """Options: ``path`` (file, glob or folder), ``split`` (default: the file's name), ``dedupe`` (drop a packet
    byte-identical to one of the last N kept ones; default off)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return PACKET_SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(CaptureSource)
