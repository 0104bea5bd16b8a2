"""Capture files read in ranges: the same frames whatever the ranges, in both formats, and in files with faults."""

import hashlib
import os
import random
import struct

import pytest

from skeinflow.sources import captures as C, files, flow_logs as L


def classic(frames, order="<", fine=1, link=1):
    magic = {("<", 1): b"\xd4\xc3\xb2\xa1", (">", 1): b"\xa1\xb2\xc3\xd4", ("<", 1000): b"\x4d\x3c\xb2\xa1", (">", 1000): b"\xa1\xb2\x3c\x4d"}[order, fine]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for ts, frame in frames:
        out += struct.pack(order + "4I", ts // 1_000_000, ts % 1_000_000 * fine, len(frame), len(frame)) + frame
    return out


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(link=1, ticks=None, order="<"):
    option = struct.pack(order + "HHB3xHH", 9, 1, ticks, 0, 0) if ticks is not None else b""
    return block(1, struct.pack(order + "HHI", link, 0, 65535) + option, order)


def packet(which, ts, frame, order="<"):
    return block(6, struct.pack(order + "5I", which, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)


def frames(n, seed=1, longest=400):
    draw = random.Random(seed)
    return [(1_700_000_000_000_000 + i * 1000, bytes(draw.randrange(256) for _ in range(draw.randrange(longest)))) for i in range(n)]


def read(spark, folder, split):
    found = C.capture_frames(spark, f"{folder}/*", split).collect()
    return sorted((os.path.basename(r["capture"]), r["seq"], r["ts_us"], r["linktype"], bytes(r["frame"])) for r in found)


def in_memory(spark, folder):
    rows = [(name, bytearray(open(f"{folder}/{name}", "rb").read())) for name in sorted(os.listdir(folder))]
    found = C.split_captures(spark.createDataFrame(rows, "capture string, content binary")).collect()
    return sorted((r["capture"], r["seq"], r["ts_us"], r["linktype"], bytes(r["frame"])) for r in found)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("captures")
    own = frames(300)
    fake = b"".join(struct.pack("<4I", 1_700_000_000, 5, 20, 20) + bytes(20) for _ in range(40))  # looks like records
    blocks = [section(), interface(), interface(101, 9)] + [packet(i % 2, ts * (1000 if i % 2 else 1), f) for i, (ts, f) in enumerate(own)]
    second = [section(">"), interface(order=">"), block(5, bytes(24), ">")] + [packet(0, ts, f, ">") for ts, f in own[:50]] + [block(3, struct.pack(">I", 7) + b"simples", ">"), packet(9, 1, b"no such interface", ">")]
    content = {
        "little.pcap": classic(own), "big.pcap": classic(own, ">"), "nanos.pcap": classic(own, "<", 1000, 101),
        "fake.pcap": classic([(ts, fake if i % 9 == 4 else f) for i, (ts, f) in enumerate(own)]),
        "long.pcap": classic([*own[:20], (own[20][0], bytes(50_000)), *own[21:60]]),
        "cut.pcap": classic(own)[:-7], "broken.pcap": classic(own[:100]) + struct.pack("<4I", 1, 1, 1 << 30, 1 << 30) + classic(own[100:])[24:],
        "blocks.pcapng": b"".join(blocks + second), "cut.pcapng": b"".join(blocks)[:-3],
        "head only.pcap": classic([]), "short.pcap": classic([])[:20], "none.txt": b"hello, this is no capture" * 50, "empty.pcap": b"", "percent%20.pcap": classic(own[:5]),
    }
    for name, data in content.items():
        (at / name).write_bytes(data)
    return str(at)


@pytest.mark.parametrize("split", [1024, 7777, 1 << 25])
def test_ranges_give_the_frames_of_the_file(spark, folder, split):
    want = in_memory(spark, folder)
    got = read(spark, folder, split)
    assert got == want
    of = lambda name: [r[4] for r in got if r[0] == name]
    own = [f for _, f in frames(300)]
    assert of("little.pcap") == of("big.pcap") == of("nanos.pcap") == own
    assert of("cut.pcap") == own[:-1] and of("broken.pcap") == own[:100] and of("percent%20.pcap") == own[:5]
    assert of("blocks.pcapng") == [*own, *own[:50], b"simples"] and of("cut.pcapng") == own[:-1]
    assert len(of("long.pcap")) == 60 and len(of("fake.pcap")) == 300
    assert {r[0] for r in got}.isdisjoint({"head only.pcap", "short.pcap", "none.txt", "empty.pcap"})
    assert [r[2] for r in got if r[0] == "nanos.pcap"] == [r[2] for r in got if r[0] == "blocks.pcapng"][:300] == [ts for ts, _ in frames(300)]
    assert {r[3] for r in got if r[0] == "blocks.pcapng"} == {1, 101}


def test_a_false_step_is_walked_again(spark, folder):
    """Ranges that begin inside bytes that look like records fall into step there, and are put right."""
    path = f"{folder}/fake.pcap"
    data = open(path, "rb").read()
    records = C.reader(C.Bytes(data, len(data)))
    places = {records.begin}
    at = records.begin
    while at < len(data):
        at += records.size(at)
        places.add(at)
    steps = [C.in_step(C.reader(C.Bytes(data, len(data))), low, low + 1024) for low in range(0, len(data), 1024)]
    assert any(s is not None and s not in places for s in steps)
    assert C.capture_frames(spark, path, 1024).count() == 300


def test_written_captures_are_read_again(spark, tmp_path):
    rows = [(f"c{i % 3}", i, 1_700_000_000_000_000 + i, 1, bytearray(bytes([i % 256] * (i % 50)))) for i in range(500)] + [("nulls", 1, 5, 1, None)]
    done = C.write_captures(spark.createDataFrame(rows, C.FRAME), str(tmp_path / "out")).collect()
    assert {(os.path.basename(r["file"]), r["frames"]) for r in done} == {("c0.pcap", 167), ("c1.pcap", 167), ("c2.pcap", 166), ("nulls.pcap", 1)}
    assert all(os.path.getsize(r["file"].removeprefix("file:")) == r["bytes"] for r in done)
    assert sorted(os.listdir(tmp_path / "out")) == ["c0.pcap", "c1.pcap", "c2.pcap", "nulls.pcap"]
    found = read(spark, tmp_path / "out", 256)
    assert [r[4] for r in found if r[0] == "c1.pcap"] == [bytes(r[4]) for r in rows if r[0] == "c1"] and found[-1][4] == b""


def test_digests_in_chunks(spark, tmp_path, monkeypatch):
    """A file larger than a chunk and a batch, one that differs, one that is missing and one that nobody registered."""
    content = {"large": bytes(range(256)) * 20_000, "changed": b"new", "extra": b"", "fine": b"x" * files.CHUNK}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert len(content["large"]) > 4 * files.CHUNK
    manifest = spark.createDataFrame([("large", sha(content["large"]).upper()), ("changed", sha(b"old")), ("gone", sha(b"")), ("fine", sha(content["fine"]))], "name string, sha256 string")
    found = {r["name"]: r["status"] for r in L.file_checksum_audit(spark, str(tmp_path / "*"), manifest).collect()}
    assert found == {"large": "ok", "changed": "mismatch", "extra": "unregistered", "gone": "missing", "fine": "ok"}
    plan = files.listed(spark, str(tmp_path / "*"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
