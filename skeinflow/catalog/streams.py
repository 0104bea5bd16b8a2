from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.flow_view import DAY_US, duck, flow_view, session_view
from ..plans.stages import new_path
from ..operators import ingest as I
from ..sources import captures as C, netflow as X, tail as L
from ..streaming import flows as S, stateful as T
from . import alerts as CA, detect as D, sessions as XC, sources as SC, windows as WC
from .registry import query, rounded

#: A stream ends at its watermark: what is still open then stays in state.
OPEN = "(SELECT max(ts_us) FROM fv)"


def stream_of(spark, df, name: str, columns: str = "*"):
    """``df`` written as files and read as a stream of one micro-batch, with its time as ts: nothing is late."""
    path = new_path(spark, name)
    df.selectExpr(*([columns] if isinstance(columns, str) else columns)).repartitionByRange(4, "ts_us").write.parquet(path)
    return S.stamped(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(path))


def stream_in_steps(spark, df, name: str, at: str, steps: int = 3):
    """``df`` written in ``steps`` files in order of ``at`` and read as a stream of as many micro-batches."""
    path = new_path(spark, name)
    cuts = df.agg(F.percentile_approx(at, F.array(*[F.lit(k / steps) for k in range(1, steps)]), 10_000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.where(F.col(at) > low)
        (part if high is None else part.where(F.col(at) <= high)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(duck(XC.BASE + f" SELECT ep_a, ep_b, protocol, initiator, start_us, end_us, fwd_packets + rev_packets AS packets, fwd_bytes + rev_bytes AS bytes FROM ses WHERE end_us + {XC.TIMEOUT_US} < (SELECT max(ts_us) FROM sv)"))
def stream_flow_sessions(spark, sf_dir):
    flows = stream_of(spark, session_view(spark, sf_dir), "in-sessions")
    return S.run_available(S.stream_flow_sessions(flows, f"{XC.TIMEOUT_US // 1_000_000} seconds"), spark, "sessions")


@query(duck(WC.DST + f" SELECT window_us, dst_ip, n, syn, ack, round(src_entropy, 6) + 0.0 AS src_entropy FROM dst WHERE window_us + {DAY_US} <= {OPEN}"))
def stream_window_features(spark, sf_dir):
    flows = stream_of(spark, flow_view(spark, sf_dir), "in-windows")
    return rounded(S.run_available(S.stream_dst_features(flows, "1 day"), spark, "windows"))


@query(duck(WC.SRC + f" SELECT window_us, src_ip, n, syn, dst_ports, dst_ips FROM src WHERE window_us + {DAY_US} <= {OPEN}"))
def stream_src_features(spark, sf_dir):
    flows = stream_of(spark, flow_view(spark, sf_dir), "in-sources")
    return S.run_available(S.stream_src_features(flows, "1 day"), spark, "sources")


@query(duck(f""", e AS (SELECT label, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h FROM (SELECT label, ch, count(*) AS c FROM (SELECT label, unnest(string_split(label, '')) AS ch FROM (SELECT DISTINCT split_part(dns_query, '.', 1) AS label FROM fv WHERE dns_query IS NOT NULL)) GROUP BY ALL) GROUP BY label),
 w AS (SELECT ts_us // {DAY_US} * {DAY_US} AS window_us, src_ip AS client, regexp_replace(dns_query, '^[^.]*\\.', '') AS domain, dns_query, dns_qtype, h FROM fv JOIN e ON e.label = split_part(dns_query, '.', 1))
 SELECT window_us, client, domain, count(*) AS queries, round(avg(length(dns_query)), 6) + 0.0 AS avg_length, round(max(h), 6) + 0.0 AS max_entropy, round(avg(CASE WHEN dns_qtype = 'TXT' THEN 1 ELSE 0 END), 6) + 0.0 AS txt_ratio FROM w WHERE window_us + {DAY_US} <= (SELECT max(ts_us) FROM fv WHERE dns_query IS NOT NULL) GROUP BY ALL"""))
def stream_domain_features(spark, sf_dir):
    flows = stream_of(spark, flow_view(spark, sf_dir), "in-domains")
    return rounded(S.run_available(S.stream_domain_features(flows, "1 day"), spark, "domains"))


@query(duck(WC.PAIR + """, c AS (SELECT src_ip, dst_ip, count(*) AS seen FROM fv GROUP BY ALL) SELECT pair.src_ip, pair.dst_ip, seen, samples, round(iat_mean, 6) + 0.0 AS iat_mean, round(iat_std, 6) + 0.0 AS iat_std, round(iat_cv, 6) + 0.0 AS iat_cv FROM pair JOIN c ON c.src_ip = pair.src_ip AND c.dst_ip = pair.dst_ip"""))
def stream_pair_beacon(spark, sf_dir):
    flows = stream_of(spark, flow_view(spark, sf_dir), "in-pairs")
    out = S.run_available(S.stream_pair_beacon(flows), spark, "pairs", "update")
    last = out.groupBy("src_ip", "dst_ip").agg(F.max_by(F.struct("*"), "seen").alias("r")).select("r.*")
    return rounded(last)


HALF_US = DAY_US // 2


@query(duck(WC.hop("dst", DAY_US, HALF_US) + f" SELECT window_us, dst_ip, n, syn, ack, round(src_entropy, 6) + 0.0 AS src_entropy FROM hop WHERE window_us + {DAY_US} <= {OPEN}"))
def stream_sliding_dst_features(spark, sf_dir):
    flows = S.stamped(stream_in_steps(spark, flow_view(spark, sf_dir), "in-hops", "ts_us"))
    return rounded(S.run_available(S.stream_dst_features(flows, "1 day", "12 hours"), spark, "hops"))


@query(duck(WC.hop("src", DAY_US, HALF_US) + f" SELECT window_us, src_ip, n, syn, dst_ports, dst_ips FROM hop WHERE window_us + {DAY_US} <= {OPEN}"))
def stream_sliding_src_features(spark, sf_dir):
    flows = S.stamped(stream_in_steps(spark, flow_view(spark, sf_dir), "in-hops", "ts_us"))
    return S.run_available(S.stream_src_features(flows, "1 day", "12 hours"), spark, "hops")


#: The counters of the frames that ``sources.frames`` makes of the flow view.
COUNTERS = """, c AS (SELECT *, event_id % 31 <> 30 AND event_id % 29 <> 28 AS o FROM fv) SELECT unnest(['packets_read', 'packets_parsed', 'dropped_fragments', 'dropped_link', 'dropped_non_ip', 'dropped_short', 'vlan_tagged', 'ipv4', 'ipv6', 'tcp', 'udp', 'icmp']) AS item,
 unnest([count(*), count(*) FILTER (WHERE o), count(*) FILTER (WHERE event_id % 31 <> 30 AND event_id % 29 = 28), 0, count(*) FILTER (WHERE event_id % 31 = 30), 0, count(*) FILTER (WHERE event_id % 7 = 6), count(*) FILTER (WHERE o), 0, count(*) FILTER (WHERE o AND protocol = 'TCP'), count(*) FILTER (WHERE o AND protocol = 'UDP'), 0]) AS value FROM c"""


@query(duck(COUNTERS))
def ingest_counters(spark, sf_dir):
    return I.counters(C.decode_frames(SC.frames(spark, sf_dir)), I.frame_counters()).where("item <> 'bytes_read'")


@query(duck(COUNTERS))
def stream_ingest_counters(spark, sf_dir):
    """The same counters, observed in a stream of three micro-batches."""
    found = C.decode_frames(stream_in_steps(spark, SC.frames(spark, sf_dir), "in-frames", "seq"))
    rows, totals = I.observed(found, I.frame_counters(), "frames")
    S.run_available(rows.drop("payload"), spark, "frames")
    return I.stop_listening(spark, totals).where("item <> 'bytes_read'")


@query(duck(XC.BASE + XC.TCP + XC.REPEATS + XC.LATE + """, way AS (SELECT dup.*, out_of_order FROM dup JOIN late ON late.ep_a = dup.ep_a AND late.ep_b = dup.ep_b AND late.protocol = dup.protocol AND late.session = dup.session AND late.forward = dup.forward)
 SELECT tcp.ep_a, tcp.ep_b, tcp.protocol, start_us, state, handshake, rtt_ms, packets, coalesce(f.duplicates, 0) AS fwd_duplicates, coalesce(v.duplicates, 0) AS rev_duplicates, coalesce(f.out_of_order, 0) AS fwd_out_of_order, coalesce(v.out_of_order, 0) AS rev_out_of_order FROM tcp
 JOIN ses ON ses.ep_a = tcp.ep_a AND ses.ep_b = tcp.ep_b AND ses.protocol = tcp.protocol AND ses.session = tcp.session
 LEFT JOIN way f ON f.ep_a = tcp.ep_a AND f.ep_b = tcp.ep_b AND f.protocol = tcp.protocol AND f.session = tcp.session AND f.forward
 LEFT JOIN way v ON v.ep_a = tcp.ep_a AND v.ep_b = tcp.ep_b AND v.protocol = tcp.protocol AND v.session = tcp.session AND NOT v.forward"""))
def stream_tcp_state(spark, sf_dir):
    """The last word on each session, of three micro-batches."""
    T.keep_state_in_rocksdb(spark)
    flows = S.stamped(stream_in_steps(spark, session_view(spark, sf_dir), "in-tcp", "ts_us"))
    out = S.run_available(T.stream_tcp_state(flows, XC.TIMEOUT_US), spark, "tcp").drop("expired")
    last = out.groupBy("ep_a", "ep_b", "protocol", "start_us").agg(F.max_by(F.struct("*"), "packets").alias("r"))
    return rounded(last.select("r.*"))


@query(duck(f"""{SC.DATAGRAMS}, d AS (SELECT source_id, event_id AS seq FROM k WHERE NOT bad), t AS (SELECT source_id, min(event_id) AS first FROM k WHERE tpl AND NOT bad GROUP BY ALL)
 SELECT d.source_id, CAST(256 AS INTEGER) AS template_id, seq, CASE WHEN seq >= first THEN 'before' ELSE 'after' END AS resolution, CAST(7 AS INTEGER) AS fields FROM d JOIN t ON t.source_id = d.source_id"""))
def stream_template_join(spark, sf_dir):
    """Datagrams in three micro-batches; data that came before their exporter's first template waited for it."""
    T.keep_state_in_rocksdb(spark)
    sets = X.netflow_flowsets(stream_in_steps(spark, SC.datagrams(spark, sf_dir), "in-netflow", "arrival_seq"))
    out = S.run_available(T.stream_template_join(sets), spark, "netflow")
    return out.select("source_id", "template_id", "seq", "resolution", F.size("fields").alias("fields"))


@query(duck(WC.DST + ", raw AS (" + D.SQL["ddos"] + ")" + D.INCIDENTS[len(D.RAW) :] + " SELECT entity_id, first_us AS ts_us FROM alerts"))
def stream_incidents(spark, sf_dir):
    rows = D.ddos(D.Inputs(spark, sf_dir)).withColumn("evidence", F.array_join(F.transform("evidence", lambda e: e["feature"]), ","))
    found = stream_of(spark, rows.select("ts_us", "threat_class", "entity_id", "confidence", "evidence"), "in-incidents")
    return S.run_available(S.stream_incidents(found, 2 * DAY_US), spark, "incidents").select("entity_id", "ts_us")


@query(duck(CA.AL + " SELECT alert_id, threat_class FROM al"))
def stream_alert_tail(spark, sf_dir):
    rows = CA.alert_table(spark, sf_dir).select("alert_id", "ts_us", "threat_class")
    found = stream_of(spark, rows.unionAll(rows), "in-alerts")
    return S.run_available(S.stream_alert_tail(found), spark, "alerts").select("alert_id", "threat_class")


@query(duck(CA.AL + " SELECT alert_id, threat_class, severity FROM al"))
def stream_tailed_alerts(spark, sf_dir):
    """Alerts of JSON-lines files, followed as files that grow: ranges of bytes, lines once each, a broken line between."""
    path = new_path(spark, "tailed")
    rows = CA.alert_table(spark, sf_dir).select("alert_id", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "threat_class", "severity")
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit('\n{"alert_id": "broken')).alias("value")).write.text(path)
    found = L.tail_alerts(spark, f"{path}/*.txt", split_bytes=1 << 14)
    return S.run_available(S.stream_alert_tail(found), spark, "tailed-alerts").select("alert_id", "threat_class", "severity")


@query(duck(CA.AL + " SELECT count(*) AS alerts, CAST(0 AS BIGINT) AS errors FROM al"))
def stream_ledger_commit(spark, sf_dir):
    from ..operators.ledger import verify_ledger

    rows = stream_in_steps(spark, CA.alert_table(spark, sf_dir).select("alert_id", "ts_us", "threat_class"), "in-ledger", "ts_us")
    path = new_path(spark, "ledger")
    rows.writeStream.foreachBatch(S.ledger_writer(path)).option("checkpointLocation", new_path(spark, "ledger-marks")).trigger(availableNow=True).start().awaitTermination()
    blocks = spark.read.parquet(f"{path}/blocks").drop("batch")
    bad = verify_ledger(blocks).where("errors <> ''").agg(F.count("*").alias("errors"))
    return blocks.agg(F.sum(F.size("leaves")).cast("long").alias("alerts")).crossJoin(bad)
