from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.scalars import ip_to_long
from ..operators import periodicity as P, templates as O
from ..operators.ledger import ordered_number
from ..plans.flow_view import duck, flow_view
from ..plans.stages import new_path
from ..sources import captures as C, flow_logs as L, netflow as X, tls as T
from . import alerts as CA
from .registry import query, rounded


def _log(spark, sf_dir):
    """The flow view as the columns of a labelled flow log."""
    k = F.col("event_id")
    rows = flow_view(spark, sf_dir)
    time = F.date_format(F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ '1970-01-01 00:00:00')"), "yyyy/MM/dd HH:mm:ss.SSSSSS")
    state = F.when(F.col("syn") & F.col("fin"), "SF").when(F.col("syn"), "S0").when(F.col("ack"), "CON").otherwise("INT")
    return rows.select(
        time.alias("StartTime"), F.lit("0.0").alias("Dur"), F.lower("protocol").alias("Proto"), F.col("src_ip").alias("SrcAddr"), F.when(k % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex("src_port")))).otherwise(F.col("src_port").cast("string")).alias("Sport"),
        F.when(k % 3 == 0, "  <->").otherwise("   ->").alias("Dir"), F.col("dst_ip").alias("DstAddr"), F.col("dst_port").cast("string").alias("Dport"), state.alias("State"), F.lit("0").alias("sTos"), F.lit("0").alias("dTos"),
        F.when(k % 10 == 0, "x").otherwise((k % 4).cast("string")).alias("TotPkts"), F.col("length").cast("string").alias("TotBytes"), F.lit("0").alias("SrcBytes"), F.concat(F.lit("flow="), F.col("event_id").cast("string")).alias("Label"),
    )


@query(duck(""" SELECT ts_us // 1 AS ts_us, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, protocol, length // greatest(CASE WHEN event_id % 10 = 0 THEN 1 ELSE event_id % 4 END, 1) AS length,
 CASE WHEN event_id % 3 = 0 THEN 'OUTBOUND_' ELSE 'OUTBOUND' END AS direction, protocol = 'TCP' AND syn AS syn, protocol = 'TCP' AND NOT syn AND ack AS ack, 'flow=' || event_id AS label FROM fv""".replace("'OUTBOUND_'", "'OUTBOUND'")))
def read_flow_log(spark, sf_dir):
    path = new_path(spark, "flow-log")
    _log(spark, sf_dir).write.option("header", True).csv(path)
    return L.read_flow_log(spark, path).select("ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "length", "direction", "syn", "ack", "label")


@query(duck(CA.AL + " SELECT alert_id, threat_class, severity, confidence, src_ip AS ip FROM al"))
def read_alerts(spark, sf_dir):
    path = new_path(spark, "alerts")
    rows = CA.alert_table(spark, sf_dir).select("alert_id", "threat_class", "severity", "confidence", F.struct(F.col("src_ip").alias("ip"), F.lit(0).alias("port")).alias("source"))
    lines = rows.select(F.to_json(F.struct("*")).alias("value")).unionAll(rows.limit(3).select(F.lit('{"alert_id": "broken').alias("value")))
    lines.write.text(path)
    return rounded(L.read_alerts(spark, path).where("alert_id is not null").select("alert_id", "threat_class", "severity", "confidence", F.col("source.ip").alias("ip")))


@query("WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS domain FROM pages) SELECT CAST(row_number() OVER (ORDER BY domain) AS INTEGER) AS rank, domain, lower(split_part(domain, '.', 1)) AS label FROM h WHERE domain <> ''")
def read_domain_rank(spark, sf_dir):
    from .scalars import hosts

    path = new_path(spark, "rank")
    names = hosts(spark, sf_dir).select("domain").distinct().where("domain <> ''")
    first = F.conv(F.rpad(F.hex(F.substring(F.encode("domain", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")  # in order of the names' bytes
    ordered_number(names.withColumn("_first", first), ["domain"], "_first").select((F.col("n") + 1).alias("rank"), "domain").write.csv(path)
    return L.read_domain_rank(spark, path)


@query(duck(" SELECT DISTINCT tls_ja3 AS ja3, 'family' || (user_id % 3) AS family FROM fv WHERE tls_ja3 IS NOT NULL"))
def read_ja3_intel(spark, sf_dir):
    path = new_path(spark, "ja3")
    rows = flow_view(spark, sf_dir).where("tls_ja3 is not null").select(F.upper("tls_ja3").alias("ja3"), F.concat(F.lit("family"), (F.col("user_id") % 3).cast("string")).alias("family")).distinct()
    rows.select(F.concat_ws(",", "ja3", "family", F.lit("2020-01-01")).alias("value")).unionAll(rows.limit(1).select(F.lit("# a comment").alias("value"))).write.text(path)
    return L.read_ja3_intel(spark, path).select("ja3", "family")


@query(duck(""", f AS (SELECT DISTINCT event_id // 250 AS part FROM fv) SELECT CAST(part AS VARCHAR) AS name, CASE part % 4 WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unregistered' ELSE 'ok' END AS status FROM f UNION ALL SELECT 'gone' || part, 'missing' FROM f WHERE part % 4 = 3"""))
def file_checksum_audit(spark, sf_dir):
    """Files of 250 flows, against digests of what they should hold: one in four has another, one in four is not registered,
    and for one in four another file is missing."""
    path = new_path(spark, "files")
    rows = flow_view(spark, sf_dir).select(F.floor(F.col("event_id") / 250).alias("part"), "event_id", F.concat_ws(",", "event_id", "src_ip").alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"]), "\n"), F.lit("\n"))
    whole = rows.groupBy("part").agg(F.sha2(text, 256).alias("sha256"))
    told = whole.where("part % 4 <> 2").select(F.col("part").cast("string").alias("name"), F.when(F.col("part") % 4 == 1, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    gone = whole.where("part % 4 = 3").select(F.concat(F.lit("gone"), F.col("part").cast("string")).alias("name"), "sha256")
    return L.file_checksum_audit(spark, f"{path}/part=*/*.txt", told.unionAll(gone), F.regexp_extract("path", "part=([0-9]+)/", 1))


def _be(value: Column | int, size: int) -> Column:
    """A number as ``size`` bytes, the highest first."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


#: The standard layout of a template, (type, length).
LAYOUT = ((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (6, 1))


def datagrams(spark, sf_dir):
    """(arrival_seq, payload): one NetFlow datagram for each flow of the view; every 50th carries a template first, and the
    first flows of a source may come before any."""
    flows = flow_view(spark, sf_dir)
    flags = F.col("fin").cast("int") + F.col("syn").cast("int") * 2 + F.col("rst").cast("int") * 4 + F.col("ack").cast("int") * 16
    record = F.concat(_be(ip_to_long(F.col("src_ip")), 4), _be(ip_to_long(F.col("dst_ip")), 4), _be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), _be(F.when(F.col("protocol") == "UDP", 17).otherwise(6), 1), _be(F.col("length"), 4), _be(flags, 1))
    data = F.concat(_be(256, 2), _be(4 + 18, 2), record)
    template = F.concat(_be(0, 2), _be(8 + 4 * len(LAYOUT), 2), _be(256, 2), _be(len(LAYOUT), 2), *[_be(x, 2) for pair in LAYOUT for x in pair])
    head = F.concat(_be(9, 2), _be(1, 2), _be(0, 4), _be(F.floor(F.col("ts_us") / 1_000_000), 4), _be(F.col("event_id"), 4), _be(F.col("user_id") % 4, 4))
    body = F.when(F.col("event_id") % 50 == 7, F.concat(template, data)).otherwise(data)
    payload = F.when(F.col("event_id") % 101 == 100, F.unhex(F.lit("0005"))).otherwise(F.concat(head, body))
    return flows.select(F.col("event_id").alias("arrival_seq"), payload.alias("payload"))


#: Which datagrams are broken, and which carry a template.
DATAGRAMS = ", k AS (SELECT event_id, CAST(user_id % 4 AS BIGINT) AS source_id, event_id % 101 = 100 AS bad, event_id % 50 = 7 AS tpl FROM fv)"


@query(duck(DATAGRAMS + """ SELECT 'corrupt' AS kind, count(*) AS n FROM k WHERE bad UNION ALL SELECT 'template', count(*) FROM k WHERE NOT bad AND tpl UNION ALL SELECT 'data', count(*) FROM k WHERE NOT bad"""))
def netflow_flowsets(spark, sf_dir):
    return X.netflow_flowsets(datagrams(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(duck(" SELECT event_id AS seq, ts_us // 1000000 * 1000000 AS ts_us, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, protocol, length, syn, ack, fin, rst FROM fv WHERE event_id % 101 <> 100"))
def netflow_decode(spark, sf_dir):
    sets = X.netflow_flowsets(datagrams(spark, sf_dir))
    data = sets.where("kind = 'data'").select("source_id", "template_id", "seq", "unix_secs", "uptime_ms", "body")
    joined = O.template_join(data, sets.where("kind = 'template'").select("source_id", "template_id", "seq", "fields"))
    return X.netflow_decode(joined).select("seq", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "length", "syn", "ack", "fin", "rst")


#: The histogram's transform as sums of cosines and sines, frequency by frequency.
SPECTRUM = """, s AS (SELECT src_ip, dst_ip, ts_us, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us DESC, event_id DESC) AS r FROM fv),
 t AS (SELECT src_ip, dst_ip, ts_us, lead(ts_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us) - ts_us AS gap FROM s WHERE r <= 64),
 p AS (SELECT src_ip, dst_ip, count(*) AS contacts, min(ts_us) AS t0, max(ts_us) - min(ts_us) AS span, coalesce(avg(gap) FILTER (WHERE gap > 50000), 0) / 1e6 AS m, coalesce(stddev_pop(gap / 1e6) FILTER (WHERE gap > 50000), 0) AS sd FROM t GROUP BY ALL HAVING count(*) >= 4),
 l AS (SELECT *, least(span // 1000000 + 1, 1024) AS bins FROM p WHERE contacts >= 6 AND span > 10000000),
 cb AS (SELECT l.src_ip, l.dst_ip, bins, contacts, least((ts_us - t0) * bins // span, bins - 1) AS b, count(*) AS c FROM t JOIN l ON l.src_ip = t.src_ip AND l.dst_ip = t.dst_ip GROUP BY ALL),
 f AS (SELECT src_ip, dst_ip, contacts, k, sqrt(power(sum(c * cos(2 * pi() * ((k * b) % bins) / bins)), 2) + power(sum(c * sin(2 * pi() * ((k * b) % bins) / bins)), 2)) AS g FROM cb, range(1, 513) z(k) WHERE k <= bins // 2 GROUP BY ALL),
 h AS (SELECT src_ip, dst_ip, k, CASE WHEN g < 1e-9 * contacts THEN 0 ELSE g END AS g FROM f), w AS (SELECT src_ip, dst_ip, max(g) AS top, sum(g) AS total FROM h GROUP BY ALL),
 pk AS (SELECT h.src_ip, h.dst_ip, min(k) AS k, arg_min(g, k) AS g, any_value(total) AS total FROM h JOIN w ON w.src_ip = h.src_ip AND w.dst_ip = h.dst_ip WHERE g >= top * (1 - 1e-9) GROUP BY ALL)
 SELECT p.src_ip, p.dst_ip, p.contacts, round(CASE WHEN total > 0 THEN k / (p.span / 1e6) WHEN total = 0 THEN 0 WHEN m > 0 THEN 1 / m ELSE 0 END, 6) + 0.0 AS dominant_hz, round(CASE WHEN total > 0 THEN p.span / 1e6 / k WHEN total = 0 THEN 0 ELSE m END, 6) + 0.0 AS dominant_s,
  round(CASE WHEN total > 0 THEN g / total WHEN total = 0 THEN 0 WHEN m > 0 AND sd < 0.1 * m THEN 0.9 ELSE 0.5 END, 6) + 0.0 AS spectral_power FROM p LEFT JOIN pk ON pk.src_ip = p.src_ip AND pk.dst_ip = p.dst_ip"""


@query(duck(SPECTRUM))
def spectral_profile(spark, sf_dir):
    return rounded(P.spectral_profile(flow_view(spark, sf_dir)))


def _text_bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _sized(body: Column, size: int) -> Column:
    """``body`` with its length in ``size`` bytes before it."""
    return F.concat(_be(F.length(body), size), body)


def _join(*parts: Column) -> Column:
    return F.concat(*parts)


def client_hello(k: Column, name: Column) -> Column:
    """A client hello with a reserved cipher, two others, a server name, curves and formats."""
    sni = _sized(_sized(F.concat(_be(0, 1), _sized(_text_bytes(name), 2)), 2), 2)
    extensions = F.concat(_be(0, 2), sni, _be(10, 2), _sized(_sized(F.concat(_be(29, 2), _be(23, 2)), 2), 2), _be(11, 2), _sized(_sized(_be(0, 1), 1), 2), _be(0x1A1A, 2), _be(0, 2))
    ciphers = F.concat(_be(0x0A0A, 2), _be(F.lit(4865) + k % 3, 2), _be(49195, 2))
    body = F.concat(_be(0x0303, 2), _be(0, 32), _sized(F.unhex(F.lit("")), 1), _sized(ciphers, 2), _sized(_be(0, 1), 1), _sized(extensions, 2))
    return F.concat(_be(22, 1), _be(0x0301, 2), _sized(F.concat(_be(1, 1), _sized(body, 3)), 2))


def server_hello(k: Column) -> Column:
    extensions = F.concat(_be(43, 2), _sized(_be(0x0304, 2), 2), _be(65281, 2), _be(0, 2))
    body = F.concat(_be(0x0303, 2), _be(0, 32), _sized(F.unhex(F.lit("")), 1), _be(F.lit(4865) + k % 3, 2), _be(0, 1), _sized(extensions, 2))
    return F.concat(_be(22, 1), _be(0x0303, 2), _sized(F.concat(_be(2, 1), _sized(body, 3)), 2))


def dns_message(name: Column, kind: Column) -> Column:
    label, rest = F.split_part(name, F.lit("."), F.lit(1)), (F.lit("example"), F.lit("com"))
    names = F.concat(*[_sized(_text_bytes(x), 1) for x in (label, *rest)], _be(0, 1))
    return F.concat(_be(7, 2), _be(0x0100, 2), _be(1, 2), _be(0, 6), names, _be(F.when(kind == "TXT", 16).otherwise(1), 2), _be(1, 2))


def frames(spark, sf_dir):
    """(capture, seq, ts_us, linktype, frame): an Ethernet frame for each flow of the view; TCP ones carry hellos, UDP ones
    names; some have a VLAN tag, some are fragments or no IP."""
    flows = flow_view(spark, sf_dir)
    k, udp = F.col("event_id"), F.col("protocol") == "UDP"
    bits = F.col("fin").cast("int") + F.col("syn").cast("int") * 2 + F.col("rst").cast("int") * 4 + F.col("ack").cast("int") * 16
    name = F.concat(F.lit("host"), (k % 40).cast("string"), F.lit(".example.com"))
    payload = F.when(udp, dns_message(F.col("dns_query"), F.col("dns_qtype"))).when(k % 3 == 0, client_hello(k, name)).when(k % 3 == 1, server_hello(k)).otherwise(_text_bytes(F.lit("hello")))
    tcp = F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), _be(k * 10 + 1, 4), _be(0, 4), _be(0x50, 1), _be(bits, 1), _be(0, 6), payload)
    l4 = F.when(udp, F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), _be(F.length(payload) + 8, 2), _be(0, 2), payload)).otherwise(tcp)
    ip = F.concat(_be(0x4500, 2), _be(F.length(l4) + 20, 2), _be(0, 2), _be(F.when(k % 29 == 28, 3).otherwise(0), 2), _be(64, 1), _be(F.when(udp, 17).otherwise(6), 1), _be(0, 2), _be(ip_to_long(F.col("src_ip")), 4), _be(ip_to_long(F.col("dst_ip")), 4), l4)
    frame = F.concat(_be(0, 12), F.when(k % 7 == 6, F.concat(_be(0x8100, 2), _be(5, 2))).otherwise(F.unhex(F.lit(""))), _be(F.when(k % 31 == 30, 0x0806).otherwise(0x0800), 2), ip)
    return flows.select(F.col("dst_ip").alias("capture"), k.alias("seq"), "ts_us", F.lit(1).alias("linktype"), frame.alias("frame"))


#: Flows in a capture file, and bytes in a range of one: small, so that small tables have many of both.
FILE_EVENTS, SPLIT_BYTES = 4096, 1 << 16


@query(duck(f""" SELECT CAST(event_id // {FILE_EVENTS} AS BIGINT) AS capture, row_number() OVER (PARTITION BY event_id // {FILE_EVENTS} ORDER BY event_id) - 1 AS seq, ts_us, CAST(1 AS INTEGER) AS linktype, CASE WHEN o THEN src_ip END AS src_ip, CASE WHEN o THEN dst_port END AS dst_port,
 CASE WHEN o THEN dns_query END AS dns_query, CASE WHEN o AND protocol = 'TCP' THEN event_id * 10 + 1 END AS tcp_seq FROM (SELECT *, event_id % 31 <> 30 AND event_id % 29 <> 28 AS o FROM fv)"""))
def capture_frames(spark, sf_dir, split_bytes=SPLIT_BYTES):
    """Frames written to capture files, read from there in ranges, and decoded."""
    path = new_path(spark, "captures")
    C.write_captures(frames(spark, sf_dir).withColumn("capture", F.floor(F.col("seq") / FILE_EVENTS).cast("string")), path)
    found = C.decode_frames(C.capture_frames(spark, f"{path}/*.pcap", split_bytes), link=True)
    name = F.regexp_extract("capture", "([0-9]+)[.]pcap$", 1).cast("long")
    return found.select(name.alias("capture"), "seq", "ts_us", "linktype", "src_ip", "dst_port", "dns_query", "tcp_seq")


@query(duck(""" SELECT event_id AS seq, CASE WHEN event_id % 31 = 30 THEN 'no_ip' WHEN event_id % 29 = 28 THEN 'fragment' ELSE 'ok' END AS status, CASE WHEN o THEN src_ip END AS src_ip, CASE WHEN o THEN dst_port END AS dst_port, CASE WHEN o THEN protocol END AS l4_proto,
 CASE WHEN o THEN CASE WHEN protocol = 'UDP' THEN 'DNS' WHEN event_id % 3 < 2 THEN 'TLS' ELSE 'TCP' END END AS app_proto, CASE WHEN o THEN syn END AS syn, CASE WHEN o THEN dns_query END AS dns_query, CASE WHEN o THEN dns_qtype END AS dns_qtype, CASE WHEN o AND protocol = 'TCP' THEN event_id * 10 + 1 END AS tcp_seq
 FROM (SELECT *, event_id % 31 <> 30 AND event_id % 29 <> 28 AS o FROM fv)"""))
def decode_frames(spark, sf_dir):
    return C.decode_frames(frames(spark, sf_dir)).select("seq", "status", "src_ip", "dst_port", "l4_proto", "app_proto", "syn", "dns_query", "dns_qtype", "tcp_seq")


def _payloads(spark, sf_dir, kind: int):
    return C.decode_frames(frames(spark, sf_dir)).where((F.col("app_proto") == "TLS") & (F.col("seq") % 3 == kind)).select("seq", "payload")


WHOLE = "protocol = 'TCP' AND event_id % 31 <> 30 AND event_id % 29 <> 28"


@query(duck(f", t AS (SELECT event_id AS seq, '771,' || (4865 + event_id % 3) || '-49195,0-10-11,29-23,0' AS ja3_string, 'host' || (event_id % 40) || '.example.com' AS sni FROM fv WHERE {WHOLE} AND event_id % 3 = 0) SELECT seq, ja3_string, md5(ja3_string) AS ja3, sni FROM t"))
def ja3_fingerprint(spark, sf_dir):
    return T.ja3_fingerprint(_payloads(spark, sf_dir, 0), "payload").drop("payload")


@query(duck(f", t AS (SELECT event_id AS seq, '771,' || (4865 + event_id % 3) || ',43-65281' AS ja3s_string FROM fv WHERE {WHOLE} AND event_id % 3 = 1) SELECT seq, ja3s_string, md5(ja3s_string) AS ja3s FROM t"))
def ja3s_fingerprint(spark, sf_dir):
    return T.ja3s_fingerprint(_payloads(spark, sf_dir, 1), "payload").drop("payload")
