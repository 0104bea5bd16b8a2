"""Small literal inputs with known results."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import scalars as S
from skeinflow.operators import evaluate as V, graph as G, incidents as I, ingest, ledger as L, models as M, networks as N, rules as R, sessions as X, tcp as T, templates as O, windows as W
from skeinflow.sources import captures, netflow

FLOW = "event_id long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, length long, syn boolean, ack boolean, fin boolean, rst boolean, dns_query string, dns_qtype string, tls_ja3 string, tcp_seq long, payload_len long"
SEC = 1_000_000


def flow(i, t, src="10.0.0.1", sport=4000, dst="203.0.113.1", dport=443, proto="TCP", length=100, syn=False, ack=False, fin=False, rst=False, name=None, kind=None, seq=0, payload=0):
    return (i, int(t * SEC), src, sport, dst, dport, proto, length, syn, ack, fin, rst, name, kind, None, seq, payload)


def flows(spark, *rows):
    return spark.createDataFrame(list(rows), FLOW)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_eight_sources_flood_one_destination(spark):
    rows = flows(spark, *[flow(i, i, src=f"10.0.0.{i}", syn=True) for i in range(8)])
    found = W.dst_window_features(rows, 10 * SEC).first()
    assert (found["n"], found["syn"], found["ack"], found["syn_ack_ratio"]) == (8, 8, 0, 8.0)
    assert found["src_entropy"] == pytest.approx(3.0)


def test_trailing_window_forgets(spark):
    rows = flows(spark, *[flow(i, 100) for i in range(5)], flow(9, 106))
    found = {r["event_id"]: r["n"] for r in W.dst_sliding_features(rows, 5 * SEC).collect()}
    assert found[9] == 1 and found[0] == 5


def test_twenty_ports(spark):
    found = W.src_window_features(flows(spark, *[flow(i, 1, dport=i + 1, syn=True) for i in range(20)]), 10 * SEC).first()
    assert (found["dst_ports"], found["syn_ratio"]) == (20, 1.0)


def test_steady_contacts(spark):
    found = W.pair_features(flows(spark, *[flow(i, 5 * i) for i in range(10)])).first()
    assert (found["samples"], found["iat_mean"]) == (10, pytest.approx(5.0))
    assert found["iat_cv"] < 0.1 and found["iat_autocorr"] > 0.5


def test_txt_queries(spark):
    name = "abcdefgh12345678.example.com"
    found = W.domain_features(flows(spark, *[flow(i, i, name=name, kind="TXT", proto="UDP") for i in range(5)]), key="full").first()
    assert (found["queries"], found["avg_length"], found["txt_ratio"]) == (5, len(name), 1.0)
    assert found["max_entropy"] > 3


def test_session_of_both_directions(spark):
    rows = flows(spark, flow(1, 1.0, length=200), flow(2, 1.05, src="203.0.113.1", sport=443, dst="10.0.0.1", dport=4000, length=1500))
    (found,) = X.flow_sessions(rows, 30 * SEC).collect()
    assert (found["fwd_packets"], found["fwd_bytes"], found["rev_packets"], found["rev_bytes"]) == (1, 200, 1, 1500)
    assert found["sizes"] == [200, -1500] and found["initiator"] == "10.0.0.1:4000"


def test_gap_equal_to_the_timeout_goes_on(spark):
    rows = flows(spark, flow(1, 0), flow(2, 10), flow(3, 20.000001))
    assert [r["session"] for r in X.flow_sessions(rows, 10 * SEC).orderBy("session").collect()] == [1, 2]


def handshake():
    return [
        flow(1, 1.0, syn=True, seq=100),
        flow(2, 1.02, src="203.0.113.1", sport=443, dst="10.0.0.1", dport=4000, syn=True, ack=True, seq=500),
        flow(3, 1.04, ack=True, seq=101),
    ]


def test_handshake(spark):
    found = X.tcp_state(flows(spark, *handshake()), 30 * SEC).first()
    assert (found["state"], found["handshake"], found["rtt_ms"]) == ("ESTABLISHED", True, pytest.approx(40.0))


def test_midstream_and_half_open(spark):
    assert X.tcp_state(flows(spark, flow(1, 1, ack=True)), 30 * SEC).first()["state"] == "MIDSTREAM_ESTABLISHED"


def test_tcp_state_of_many_retries(spark):
    n = 5000
    back = {"src": "203.0.113.1", "sport": 443, "dst": "10.0.0.1", "dport": 4000}
    rows = [*[flow(i, i / 100, syn=True) for i in range(n)], flow(n, 50, syn=True, ack=True, **back), flow(n + 1, 50.01, ack=True)]
    found = X.tcp_state(flows(spark, *rows), 30 * SEC).first()
    assert (found["packets"], found["state"], found["handshake"], found["rtt_ms"]) == (n + 2, "ESTABLISHED", True, pytest.approx(20.0))


def test_tcp_state_equals_the_fold_of_all_packets(spark):
    draw, back = random.Random(3), {"src": "203.0.113.1", "sport": 443, "dst": "10.0.0.1"}
    rows = []
    for port in range(300):
        for i in range(draw.randint(1, 12)):
            flags = {f: draw.random() < p for f, p in (("syn", 0.6), ("ack", 0.4), ("fin", 0.12), ("rst", 0.05))}
            rows.append(flow(len(rows), i, dport=port + 1, **flags) if draw.random() < 0.5 or not i else flow(len(rows), i, **(back | {"sport": port + 1}), dport=4000, **flags))
    data = flows(spark, *rows)
    shown = lambda df: sorted(map(str, df.select(*X.KEYS, "session", "packets", "state", "handshake", "rtt_ms").collect()))
    packet = F.struct("place", "forward", "syn", "ack", "fin", "rst", "ts_us")
    whole = X.with_sessions(data, 30 * SEC).groupBy(*X.KEYS, "session").agg(F.count("*").alias("packets"), F.array_sort(F.collect_list(packet)).alias("p"))
    assert shown(X.tcp_state(data, 30 * SEC)) == shown(whole.withColumn("s", F.aggregate("p", T.start_state(), T.step)).select("*", "s.*"))


def test_duplicates_and_late_packets(spark):
    again = flows(spark, flow(1, 1, seq=2000, payload=500), flow(2, 2, seq=2000, payload=500))
    assert X.tcp_duplicates(again, 30 * SEC).first()["duplicates"] == 1
    late = flows(spark, flow(1, 1, seq=1000, payload=1000), flow(2, 2, seq=500, payload=10))
    assert X.tcp_out_of_order(late, 30 * SEC).first()["out_of_order"] == 1
    # a late packet that reaches further does not move what is expected
    rows = flows(spark, flow(1, 1, seq=1000, payload=1000), flow(2, 2, seq=1500, payload=5000), flow(3, 3, seq=2000, payload=10))
    assert X.tcp_out_of_order(rows, 30 * SEC).first()["out_of_order"] == 1


def test_incidents_split_by_gap(spark):
    evidence = F.array(F.struct(F.lit("f").alias("feature"), F.lit(1.0).alias("value"), F.lit(1.0).alias("threshold"), F.lit("rule").alias("source")))
    rows = spark.createDataFrame([(1000 * SEC,), (1005 * SEC,), (1075 * SEC,)], "ts_us long").select("ts_us", F.lit("VOLUMETRIC_DDOS").alias("threat_class"), F.lit("a").alias("entity_id"), F.lit(0.9).alias("confidence"), F.lit("HIGH").alias("severity"), F.lit("T").alias("technique"), evidence.alias("evidence"))
    found = I.dedup_incidents(rows).orderBy("first_us").collect()
    assert [(r["first_us"], r["detections"]) for r in found] == [(1000 * SEC, 2), (1075 * SEC, 1)]
    assert [e["feature"] for e in found[0]["evidence"]] == ["f", "incident_cluster_size"]


def test_flood_rule(spark):
    row = spark.createDataFrame([(0, "d", 5000, 500.0, 240.0, 4.8, 0.0)], "window_us long, dst_ip string, n long, pps double, syn_ack_ratio double, src_entropy double, amplification double")
    found = R.detect_ddos(row).first()
    assert [e["feature"] for e in found["evidence"]] == ["syn_to_ack_ratio", "incoming_pps", "src_ip_entropy"]
    assert (found["confidence"], found["severity"], found["technique"]) == (0.9, "CRITICAL", "T1498.001")


def test_model_alone_is_evidence(spark):
    row = spark.createDataFrame([(0, "d", 1, 1.0, 0.0, 0.0, 0.0)], "window_us long, dst_ip string, n long, pps double, syn_ack_ratio double, src_entropy double, amplification double")
    assert R.detect_ddos(row).count() == 0
    assert [e["feature"] for e in R.detect_ddos(row, ml=F.lit(0.95)).first()["evidence"]] == ["model_probability"]


def test_metrics(spark):
    outcomes = [(1, 1)] * 30 + [(0, 1)] * 10 + [(1, 0)] * 10 + [(0, 0)] * 50
    rows = spark.createDataFrame([(t, p, float(p), str(i % 20)) for i, (t, p) in enumerate(outcomes)], "y_true int, y_pred int, y_prob double, grp string")
    found = V.classification_metrics(rows).first()
    assert (found["precision"], found["recall"], found["f1"]) == (0.75, 0.75, 0.75)
    for group in ("grp", None):
        for r in V.bootstrap_ci(rows, group, 100).collect():
            assert r["low"] <= r["value"] <= r["high"]
    assert V.roc_auc(rows).first()["auc"] == pytest.approx((0.75 + 50 / 60) / 2)


def test_operations(spark):
    events = [(100.0 + i, "h1", True) for i in range(3)] + [(500.0 + i, "h2", False) for i in range(3)] + [(900.0 + i, "h3", False) for i in range(3)]
    found = I.incident_operations(spark.createDataFrame(events, "ts double, entity string, is_attack boolean"), 95.0, 2.0).first()
    assert (found["alerts"], found["incidents"], found["false_incidents"], found["false_per_hour"], found["seconds_to_detect"]) == (9, 3, 2, 1.0, 5.0)


def test_groups(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", "w"), (5, "c", "v"), (6, "d", "z")], "k long, s string, r string")
    assert {r["k"]: r["group"] for r in G.connected_groups(rows, "k", ["s", "r"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 3}
    bridged = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "k long, s string")
    with pytest.raises(ValueError):
        G.connected_groups(bridged, "k", ["s"])
    with pytest.raises(ValueError):
        M.group_split(bridged, "s")


def _root(leaves):
    layer = [bytes.fromhex(x) for x in leaves]
    while len(layer) > 1:
        layer += layer[-1:] * (len(layer) % 2)
        layer = [hashlib.sha256(a + b).digest() for a, b in zip(layer[::2], layer[1::2])]
    return layer[0].hex() if layer else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 5000])
def test_merkle_root(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    assert value(spark, L.merkle_root(F.split(F.lit(",".join(leaves)), ",") if n else F.array().cast("array<string>"))) == _root(leaves)


def test_ledger_finds_changes(spark):
    alerts = spark.range(25).select(F.col("id").cast("string").alias("alert_id"), (F.col("id") * 1000).alias("ts_us"))
    blocks = L.ledger_chain(alerts)
    assert [r["errors"] for r in L.verify_ledger(blocks).orderBy("block_height").collect()] == ["", "", ""]
    changed = blocks.withColumn("block_hash", F.when(F.col("block_height") == 1, F.lit("0" * 64)).otherwise(F.col("block_hash")))
    assert [r["errors"] for r in L.verify_ledger(changed).orderBy("block_height").collect()] == ["", "block_hash", "previous_hash"]


def test_directions(spark):
    nets = spark.createDataFrame([("10.0.0.0/8",), ("nonsense",)], "cidr string")
    rows = spark.createDataFrame([(1, "10.1.1.1", "10.2.2.2"), (2, "10.1.1.1", "8.8.8.8"), (3, "8.8.8.8", "10.1.1.1"), (4, "8.8.8.8", "oops")], "event_id long, src_ip string, dst_ip string")
    assert [r["direction"] for r in N.classify_direction(rows, nets).orderBy("event_id").collect()] == ["LATERAL", "OUTBOUND", "INBOUND", "TRANSIT"]
    large = N.ip_in_networks(rows, nets, "dst_ip", large=True)
    assert [r["inside"] for r in large.orderBy("event_id").collect()] == [True, False, True, False]


def test_orphan_and_redefined_templates(spark):
    fields = lambda *p: [{"type": t, "len": n} for t, n in p]
    body = bytes([10, 0, 0, 1, 10, 0, 0, 2]) + (9999).to_bytes(4, "big")
    data = spark.createDataFrame([(1, 256, 5, 1000, 0, bytearray(body)), (1, 256, 9, 1000, 0, bytearray(body)), (2, 256, 1, 0, 0, bytearray(b""))], "source_id long, template_id int, seq long, unix_secs long, uptime_ms long, body binary")
    marks = spark.createDataFrame([(1, 256, 7, fields((8, 4), (12, 4), (1, 4)))], f"source_id long, template_id int, seq long, fields {netflow.FIELDS}")
    joined = O.template_join(data, marks)
    assert {(r["source_id"], r["seq"]): r["resolution"] for r in joined.collect()} == {(1, 5): "after", (1, 9): "before", (2, 1): "none"}
    found = netflow.netflow_decode(joined).first()
    assert (found["src_ip"], found["dst_ip"], found["length"]) == ("10.0.0.1", "10.0.0.2", 9999)


def test_scalars(spark):
    assert value(spark, S.shannon_entropy(F.lit(""))) == 0.0
    assert value(spark, S.shannon_entropy(F.lit("abab"))) == pytest.approx(1.0)
    assert value(spark, S.byte_entropy(F.lit(bytearray(range(256))).cast("binary"))) == pytest.approx(8.0)
    assert [value(spark, S.parse_flow_port(F.lit(x))) for x in ("", "0x1bb", "53", "ssh", "zzz")] == [0, 443, 53, 22, 0]
    assert value(spark, S.subnet_group(F.lit("2001:db8:1:2::3"))) == "2001:db8:1::/48"
    assert value(spark, S.anomaly_to_prob(F.lit(0.0))) == 0.5
    assert value(spark, S.pst_pattern_matches(F.array(*map(F.lit, (200, -1500, 300, 10))))) == 2
    assert math.isclose(value(spark, S.autocorr_peak(F.array(*[F.lit(float(x)) for x in (1, 2, 1, 2, 1, 2)]))), 4 / 6, rel_tol=1e-9)


def test_fragments_are_no_events():
    def v4(flags):
        return bytes([0x45, 0, 0, 28, 0, 1, *flags, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + bytes([0, 53, 0, 54, 0, 8, 0, 0])

    ethernet = bytes(12) + b"\x08\x00"
    assert [captures.decode(1, ethernet + v4(flags))[0] for flags in ((0, 0), (0x40, 0), (0x20, 0), (0, 1))] == ["ok", "ok", "fragment", "fragment"]
    v6 = bytes([0x60, 0, 0, 0, 0, 8, 44, 64]) + bytes(32) + bytes(8)
    assert captures.decode(1, bytes(12) + b"\x86\xdd" + v6)[0] == "fragment"


def test_network_tables_on_both_sides_of_the_bound(spark, monkeypatch):
    """Ranges against a broadcast up to the bound, prefixes beyond it: the same answers."""
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), ("192.168.1.0/24",), ("8.8.8.8/32",)], "cidr string")
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(["10.1.2.3", "11.0.0.0", "9.255.255.255", "10.255.255.255", "192.168.1.255", "192.168.2.0", "8.8.8.8", "8.8.8.9", "x", None])], "k long, ip string")
    answers = []
    for bound in (3, 4, 5):
        monkeypatch.setattr(N, "RANGE_JOIN_ROWS", bound)
        found = N.ip_in_networks(rows, nets, "ip")
        assert ("cidr" in str(found.columns)) is False
        answers.append([r["inside"] for r in found.orderBy("k").collect()])
    assert answers[0] == answers[1] == answers[2] == [True, False, False, True, True, False, True, False, False, False]


def test_options_templates_and_reserved_flowsets(spark):
    def flowset(which, body):
        return which.to_bytes(2, "big") + (4 + len(body)).to_bytes(2, "big") + body

    number = lambda *xs: b"".join(x.to_bytes(2, "big") for x in xs)
    head = number(9, 1) + bytes(4) + (1000).to_bytes(4, "big") + bytes(4) + (7).to_bytes(4, "big")
    options = flowset(1, number(300, 4, 8, 1, 4, 34, 4, 35, 1) + bytes(2))
    broken = flowset(1, number(301, 40, 8, 1, 4))
    rows = [(1, bytearray(head + options + flowset(2, b"abcd") + flowset(300, b"data"))), (2, bytearray(head + broken)), (3, bytearray(b"short")), (4, None)]
    found = netflow.netflow_flowsets(spark.createDataFrame(rows, "arrival_seq long, payload binary")).collect()
    got = [(r["seq"], r["kind"], r["template_id"], r["fields"] and [tuple(f) for f in r["fields"]], r["scope_fields"]) for r in found]
    assert got == [(1, "options", 300, [(1, 4), (34, 4), (35, 1)], 1), (1, "reserved", 2, None, None), (1, "data", 300, None, None), (3, "corrupt", None, None, None), (4, "corrupt", None, None, None)]


def test_causes_of_drops_are_counted(spark):
    v4 = bytes([0x45, 0, 0, 28, 0, 1, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + bytes([0, 53, 0, 54, 0, 8, 0, 0])
    v6 = bytes([0x60, 0, 0, 0, 0, 8, 58, 64]) + bytes(32) + bytes(8)
    ether = lambda kind, body: bytes(12) + kind + body
    frames = [(1, ether(b"\x08\x00", v4)), (1, ether(b"\x81\x00\x00\x05\x08\x00", v4)), (1, ether(b"\x86\xdd", v6)), (1, ether(b"\x08\x06", b"arp")), (113, b"cooked"), (1, b"tiny"), (1, ether(b"\x08\x00", v4[:6] + b"\x20\x00" + v4[8:]))]
    rows = spark.createDataFrame([("c", i, 0, link, bytearray(f)) for i, (link, f) in enumerate(frames)], captures.FRAME)
    found = {r["item"]: r["value"] for r in ingest.counters(captures.decode_frames(rows), ingest.frame_counters()).collect()}
    assert found == {"bytes_read": sum(len(f) for _, f in frames), "packets_read": 7, "packets_parsed": 3, "dropped_fragments": 1, "dropped_link": 1, "dropped_non_ip": 1, "dropped_short": 1, "vlan_tagged": 1, "ipv4": 2, "ipv6": 1, "tcp": 0, "udp": 2, "icmp": 1}
