"""Packet captures: files -> frames -> flow events.

Frames are cut and decoded by small functions on bytes inside Arrow batches: offsets depend on the bytes before them, which
column expressions cannot follow without one expression per header layout.
"""

from __future__ import annotations

import ipaddress
import struct
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.stages import settle
from .files import file_ranges, listed, located, opened, qualified

#: Link types, Ethernet types, and the names of DNS record types.
ETHERNET, RAW_IP = 1, 101
IPV4, IPV6, VLANS = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100)
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
DNS_PORTS = {53, 5353}
QUIC_KINDS = ("initial", "0rtt", "handshake", "retry")

FRAME = "capture string, seq long, ts_us long, linktype int, frame binary"
EVENT = "capture string, seq long, ts_us long, status string, src_ip string, src_port int, dst_ip string, dst_port int, l4_proto string, app_proto string, length long, payload_len long, syn boolean, ack boolean, fin boolean, rst boolean, psh boolean, urg boolean, tcp_seq long, tcp_ack long, dns_query string, dns_qtype string, dns_is_response boolean, dns_answers int, quic_version long, quic_kind string, payload binary, vlan boolean, frame_bytes long"


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return [(n, types[t]) for n, t in (x.split() for x in schema.split(", "))]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _kinds(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip([*zip(*rows)] or [()] * len(kinds), kinds)], [n for n, _ in kinds])


#: First bytes of a classic capture -> byte order, and ticks of a time's second part in a microsecond.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION = b"\x0a\x0d\x0d\x0a"
HEADER = 24

#: A range is in step once so many records in a row, or those up to the end of the file, have headers that can be such.
CHAIN = 6
MOST_FRAME = 1 << 18
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20


class Bytes:
    """A file, or bytes, read at any place, with one block of it in memory."""

    def __init__(self, source, length: int):
        self.source, self.length, self.low, self.block = source, length, 0, b""

    def at(self, place: int, n: int) -> bytes:
        i = place - self.low
        if i < 0 or i + n > len(self.block):
            if isinstance(self.source, bytes):
                self.low, self.block = 0, self.source
            else:
                self.low, self.block = place, self.source.read_at(min(max(n, 1 << 20), self.length - place), place) if place < self.length else b""
            i = place - self.low
        return self.block[i : i + n]


class Classic:
    """Records of a classic capture, by place in the file."""

    def __init__(self, data: Bytes):
        head = data.at(0, HEADER)
        self.data, self.begin = data, HEADER
        self.order, self.fine = CLASSIC[head[:4]]
        snap, link = struct.unpack_from(self.order + "2I", head, 16) if len(head) == HEADER else (0, 0)
        self.link, self.most = link & 0xFFFF, max(snap, MOST_FRAME)

    def size(self, at: int) -> int:
        """The length of the record at a place; 0 if it breaks its bounds."""
        head = self.data.at(at, 16)
        if len(head) < 16:
            return 0
        kept = struct.unpack_from(self.order + "I", head, 8)[0]
        return 16 + kept if at + 16 + kept <= self.data.length else 0

    def plausible(self, at: int) -> int:
        """The length of what may be a record at any byte, else 0."""
        head = self.data.at(at, 16)
        if len(head) < 16:
            return 0
        _, part, kept, whole = struct.unpack_from(self.order + "4I", head)
        return self.size(at) if part < 1_000_000 * self.fine and kept <= whole and kept <= self.most else 0

    def is_packet(self, at: int) -> bool:
        return True

    def tell(self, at: int) -> bytes:
        return b""

    def learn(self, told: bytes) -> None:
        pass

    def frame(self, at: int, size: int):
        record = self.data.at(at, size)
        secs, part = struct.unpack_from(self.order + "2I", record)
        return secs * 1_000_000 + part // self.fine, self.link, record[16:]


class Blocks:
    """Records of a block capture: sections, interfaces, enhanced and simple packets."""

    KINDS = (0x0A0D0D0A, 1, 2, 3, 4, 5, 6, 0xBAD, 0x40000BAD)

    def __init__(self, data: Bytes):
        self.data, self.begin, self.order, self.interfaces = data, 0, "<", []
        self.learn(data.at(0, 12))

    def _is_section(self, at: int) -> bool:
        return self.data.at(at, 4) == SECTION

    def size(self, at: int) -> int:
        head = self.data.at(at, 12)
        if len(head) < 12:
            return 0
        if head[:4] == SECTION:
            self.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        size = struct.unpack_from(self.order + "I", head, 4)[0]
        return size if size >= 12 and at + size <= self.data.length else 0

    def plausible(self, at: int) -> int:
        if at % 4:
            return 0
        was = self.order
        for order in (was, "<" if was == ">" else ">"):  # a later section may have the other byte order
            self.order = order
            size = self.size(at)
            kind = struct.unpack_from(self.order + "I", self.data.at(at, 4))[0] if size else None
            if size and size % 4 == 0 and kind in self.KINDS and self.data.at(at + size - 4, 4) == self.data.at(at + 4, 4):
                return size
        self.order = was
        return 0

    def kind(self, at: int) -> int:
        return struct.unpack_from(self.order + "I", self.data.at(at, 4))[0]

    def is_packet(self, at: int) -> bool:
        return self.kind(at) in (3, 6)

    def tell(self, at: int) -> bytes:
        """The bytes of a record that says how later ones are to be read."""
        return self.data.at(at, self.size(at)) if self._is_section(at) or self.kind(at) == 1 else b""

    def learn(self, told: bytes) -> None:
        """Takes in sections and interfaces, one after the other."""
        at = 0
        while at + 12 <= len(told):
            if told[at : at + 4] == SECTION:
                self.order, self.interfaces = ("<" if told[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
            size = struct.unpack_from(self.order + "I", told, at + 4)[0]
            if told[at : at + 4] != SECTION and size >= 20:
                body = told[at + 8 : at + size - 4]
                ticks, i = 1_000_000, 8
                while i + 4 <= len(body):
                    code, n = struct.unpack_from(self.order + "HH", body, i)
                    if code == 9 and n:
                        ticks = 2 ** (body[i + 4] & 127) if body[i + 4] & 128 else 10 ** body[i + 4]
                    if code == 0:
                        break
                    i += 4 + (n + 3) // 4 * 4
                self.interfaces.append((struct.unpack_from(self.order + "H", body)[0], ticks))
            at += max(size, 12)

    def frame(self, at: int, size: int):
        """(ts_us, linktype, frame) of a packet; None for one of an unknown interface."""
        body, kind = self.data.at(at, size)[8:-4], self.kind(at)
        if kind == 6 and len(body) >= 20:
            which, high, low, kept, _ = struct.unpack_from(self.order + "5I", body)
            if which < len(self.interfaces):
                link, ticks = self.interfaces[which]
                return ((high << 32) | low) * 1_000_000 // ticks, link, body[20 : 20 + kept]
        elif kind == 3 and self.interfaces and len(body) >= 4:
            return 0, self.interfaces[0][0], body[4 : 4 + struct.unpack_from(self.order + "I", body)[0]]
        return None


def reader(data: Bytes):
    """The reader of a file's format; None for what is no capture."""
    magic = data.at(0, 4)
    return Blocks(data) if magic == SECTION else Classic(data) if magic in CLASSIC and data.length >= HEADER else None


def in_step(records, low: int, high: int) -> int | None:
    """The first place from ``low`` at which a chain of plausible records begins; None if there is none below ``high`` or in
    the bytes of two frames."""
    if low <= records.begin:
        return records.begin
    for at in range(low, min(high, low + 2 * MOST_FRAME)):
        place, n = at, 0
        while n < CHAIN and place < records.data.length and (size := records.plausible(place)):
            place, n = place + size, n + 1
        if n == CHAIN or (n and place == records.data.length):
            return at
    return None


def walk(records, start: int, high: int):
    """(stop, records, told) of a range: where the first record from ``high`` on begins (-1 if the chain breaks before), the
    number of packets, and the bytes that say how to read what follows."""
    at, n, told = start, 0, b""
    while at < high:
        size = records.size(at)
        if not size:
            return -1, n, told
        n += records.is_packet(at)
        told += records.tell(at)
        at += size
    return at, n, told


#: ``start`` is null for a range that found no step of its own, and -1 for one that has no records.
INDEX = "path string, length long, low long, high long, start long, stop long, records long, told binary"
STEPS = "path string, length long, start long, stop long, first long, told binary"


def _index_batches(batches):
    for batch in batches:
        rows = []
        for path, length, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(path) as file:
                records = reader(Bytes(file, length))
                start = in_step(records, low, high) if records else -1
                stop, n, told = walk(records, start, high) if start is not None and start >= 0 else (None, 0, b"")
            rows.append((path, length, low, high, start, stop, n, told))
        yield _batch(rows, INDEX)


def _steps(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file, in order, as far as its chain of records goes: each begins where the one before it stopped. A
    range that fell into step elsewhere, or nowhere, is walked again from there."""
    out, expected, first, told = [], None, 0, b""
    for r in frame.sort_values("low").itertuples():
        start, stop, n, own = r.start, r.stop, r.records, r.told
        if expected is None and start < 0:
            break  # no capture
        if expected is not None:
            if expected < 0 or expected >= r.length:
                break
            if expected >= r.high:
                continue  # inside a record
            if pd.isna(start) or start != expected:
                with opened(r.path) as file:
                    records = reader(Bytes(file, r.length))
                    records.learn(told)
                    start = expected
                    stop, n, own = walk(records, start, r.high)
        out.append((r.path, r.length, int(start), int(stop), first, told))
        expected, first, told = int(stop), first + int(n), told + own
    return pd.DataFrame(out, columns=[x.split()[0] for x in STEPS.split(", ")])


def _read(records, start: int, stop: int, first: int):
    """(seq, ts_us, linktype, frame) of the packets from ``start`` to ``stop``, or to where the chain breaks."""
    at, seq = start, first
    while at < stop if stop >= 0 else True:
        size = records.size(at)
        if not size:
            return
        records.learn(records.tell(at))
        if records.is_packet(at):
            found = records.frame(at, size)
            if found:
                yield seq, *found
            seq += 1
        at += size


def _in_batches(capture: str, frames):
    rows, size = [], 0
    for found in frames:
        rows.append((capture, *found))
        size += len(found[-1])
        if len(rows) == 10_000 or size >= BATCH_BYTES:
            yield _batch(rows, FRAME)
            rows, size = [], 0
    yield _batch(rows, FRAME)


def _range_batches(batches):
    for batch in batches:
        for path, length, start, stop, first, told in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(path) as file:
                records = reader(Bytes(file, length))
                records.learn(told)
                yield from _in_batches(path, _read(records, start, stop, first))


def capture_frames(spark: SparkSession, glob: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames (capture, seq, ts_us, linktype, frame) of capture files of any size, classic or in blocks.

    A file is cut into ranges of bytes. Each range falls into step by itself, where a chain of records begins whose headers
    can be such, and counts its records; then the ranges of a file are laid end to end: each has to begin where the one before
    stopped, and one that does not (its bytes only looked like records) is walked again. So the frames are those of a reader
    from the start of the file, ``seq`` is their place among its packets, and an end cut short or a broken record ends the
    file there. Files that are no captures give none."""
    index = file_ranges(listed(spark, glob), split_bytes).mapInArrow(_index_batches, INDEX)
    steps = settle(index.groupBy("path").applyInPandas(_steps, STEPS), "capture-ranges")
    return steps.repartition(max(1, steps.count()), "path", "start").mapInArrow(_range_batches, FRAME)


def _frames(batches):
    for batch in batches:
        for capture, data in zip(*(c.to_pylist() for c in batch.columns)):
            records = reader(Bytes(data or b"", len(data or b"")))
            if records:
                yield from _in_batches(capture, _read(records, records.begin, -1, 0))


def split_captures(contents: DataFrame) -> DataFrame:
    """Frames of captures (capture, content) that are in memory; what is no capture gives none."""
    return contents.select(F.col("capture").cast("string"), F.col("content").cast("binary")).mapInArrow(_frames, FRAME)


def _classic_record(ts_us: int, frame: bytes) -> bytes:
    return struct.pack("<4I", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), len(frame)) + frame


def write_captures(frames: DataFrame, path: str) -> DataFrame:
    """Writes a classic capture file ``<path>/<capture>.pcap`` for each ``capture`` of frames (capture, seq, ts_us, linktype,
    frame), in order of ``seq``; returns (file, frames, bytes). All frames of a file have one link type.

    A file grows in a task under a name of its own and is renamed when it is whole: a task that runs again writes it again."""
    spark = frames.sparkSession
    folder = qualified(spark, path)

    def run(batches):
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        name, sink, written, done = None, None, [0, 0], []

        def close():
            if name is not None:
                sink.close()
                system.move(f"{root}/{hidden}", f"{root}/{name}.pcap")
                done.append((f"{folder}/{name}.pcap", *written))

        for batch in batches:
            for capture, ts, link, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if capture != name:
                    close()
                    name, hidden, written = capture, f".{capture}-{uuid.uuid4().hex}", [0, HEADER]
                    sink = system.open_output_stream(f"{root}/{hidden}")
                    sink.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MOST_FRAME, link))
                sink.write(_classic_record(ts, frame))
                written = [written[0] + 1, written[1] + 16 + len(frame)]
        close()
        yield _batch(done, "file string, frames long, bytes long")

    rows = frames.where("capture is not null").repartition("capture").sortWithinPartitions("capture", "seq").select("capture", "ts_us", "linktype", F.coalesce("frame", F.lit(b"")).alias("frame"))
    return settle(rows.mapInArrow(run, "file string, frames long, bytes long"), "captures-written")


def _dns(data: bytes):
    """(name, type, is response, answers) of a message's first question; None for what is none."""
    if len(data) < 12:
        return None
    flags, questions, answers = struct.unpack_from("!HHH", data, 2)
    at, labels = 12, []
    while questions and at < len(data) and data[at]:
        n = data[at]
        if n > 63 or at + 1 + n > len(data) or len(labels) > 126:
            return None
        labels.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
        at += 1 + n
    if not labels or at + 3 > len(data):
        return None
    kind = struct.unpack_from("!H", data, at + 1)[0]
    return ".".join(labels).lower(), DNS_TYPES.get(kind, str(kind)), bool(flags & 0x8000), answers


def decode(link: int, frame: bytes) -> tuple:
    """The columns of an event from ``status`` on; status is ok, or why the frame is none."""
    at, kind, vlan = 0, None, False
    nothing = lambda why: (why, *[None] * 23, vlan, len(frame))
    if link not in (ETHERNET, RAW_IP):
        return nothing("link")
    if link == ETHERNET:
        if len(frame) < 14:
            return nothing("short")
        kind, at = struct.unpack_from("!H", frame, 12)[0], 14
        while kind in VLANS:
            vlan = True
            if len(frame) < at + 4:
                return nothing("short")
            kind, at = struct.unpack_from("!H", frame, at + 2)[0], at + 4
    elif link == RAW_IP and frame:
        kind = {4: IPV4, 6: IPV6}.get(frame[0] >> 4)
    if kind == IPV4:
        if len(frame) < at + 20:
            return nothing("short")
        head, length = (frame[at] & 15) * 4, struct.unpack_from("!H", frame, at + 2)[0]
        if struct.unpack_from("!H", frame, at + 6)[0] & 0x3FFF:  # an offset, or more to come
            return nothing("fragment")
        proto, src, dst = frame[at + 9], frame[at + 12 : at + 16], frame[at + 16 : at + 20]
        end, at = at + length, at + head
    elif kind == IPV6:
        if len(frame) < at + 40:
            return nothing("short")
        length, proto = struct.unpack_from("!H", frame, at + 4)[0] + 40, frame[at + 6]
        if proto == 44:
            return nothing("fragment")
        src, dst, end, at = frame[at + 8 : at + 24], frame[at + 24 : at + 40], at + length, at + 40
    else:
        return nothing("no_ip")
    src, dst = str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst))
    rest = frame[at : min(end, len(frame))]
    flags, seq, ack, ports, payload = 0, None, None, (0, 0), rest
    l4 = app = {1: "ICMP", 58: "ICMP", 6: "TCP", 17: "UDP"}.get(proto, f"IP_PROTO_{proto}")
    if proto == 6 and len(rest) >= 20:
        *ports, seq, ack = struct.unpack_from("!HHII", rest)
        flags, payload = rest[13], rest[(rest[12] >> 4) * 4 :]
    elif proto == 17 and len(rest) >= 8:
        ports, payload = struct.unpack_from("!HH", rest), rest[8:]
    elif proto in (6, 17):
        return nothing("short")
    dns, quic = None, (None, None)
    if DNS_PORTS & {*ports}:
        dns = _dns(payload[2:] if proto == 6 else payload)
    if dns:
        app = "DNS"
    elif proto == 17 and 443 in ports and len(payload) >= 5 and payload[0] & 0xC0 == 0xC0:
        app, quic = "QUIC", (struct.unpack_from("!I", payload, 1)[0], QUIC_KINDS[payload[0] >> 4 & 3])
    elif proto == 6 and payload[:1] == b"\x16":
        app = "TLS"
    bits = [bool(flags & b) for b in (2, 16, 1, 4, 8, 32)]
    return ("ok", src, ports[0], dst, ports[1], l4, app, length, len(payload), *bits, seq, ack, *(dns or (None,) * 4), *quic, payload, vlan, len(frame))


def _events(batches, link: bool):
    schema = EVENT + ", linktype int" * link
    for batch in batches:
        rows = [(c, s, t, *decode(kind, frame or b""), *[kind] * link) for c, s, t, kind, frame in zip(*(x.to_pylist() for x in batch.columns))]
        yield _batch(rows, schema)


def decode_frames(frames: DataFrame, link: bool = False) -> DataFrame:
    """Events of frames, one for each; rows whose status is not ok say why a frame is no event. With ``link`` the frame's
    linktype comes after them."""
    return frames.select("capture", "seq", "ts_us", "linktype", "frame").mapInArrow(lambda b: _events(b, link), EVENT + ", linktype int" * link)
