from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..plans.flow_view import duck, session_view
from .registry import query, rounded

#: Half a day: the events of the view stand about four minutes apart.
TIMEOUT_US = 43_200_000_000

BASE = f""", e AS (SELECT *, src_ip || ':' || src_port AS s, dst_ip || ':' || dst_port AS d FROM sv),
 k AS (SELECT *, least(s, d) AS ep_a, greatest(s, d) AS ep_b FROM e),
 g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {TIMEOUT_US} THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY ep_a, ep_b, protocol ORDER BY ts_us, event_id)),
 n AS (SELECT *, sum(new) OVER (PARTITION BY ep_a, ep_b, protocol ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
 r AS (SELECT *, row_number() OVER w AS place, s = first_value(s) OVER w AS forward FROM n WINDOW w AS (PARTITION BY ep_a, ep_b, protocol, session ORDER BY ts_us, event_id)),
 ses AS (SELECT ep_a, ep_b, protocol, CAST(session AS BIGINT) AS session, arg_min(s, place) AS initiator, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) FILTER (WHERE forward) AS fwd_packets, count(*) FILTER (WHERE NOT forward) AS rev_packets,
  CAST(coalesce(sum(length) FILTER (WHERE forward), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(length) FILTER (WHERE NOT forward), 0) AS BIGINT) AS rev_bytes,
  coalesce(arg_max(syn, place) FILTER (WHERE forward), false) AS fwd_syn, coalesce(arg_max(ack, place) FILTER (WHERE NOT forward), false) AS rev_ack, arg_min(tls_ja3, place) FILTER (WHERE tls_ja3 IS NOT NULL) AS tls_ja3,
  string_agg(CAST(CASE WHEN forward THEN length ELSE -length END AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 64) AS sizes, (max(ts_us) - min(ts_us)) / 1e6 AS duration_s FROM r GROUP BY ALL)"""
ID = "ep_a, ep_b, protocol, session"


def sessions(spark, sf_dir):
    return S.flow_sessions(session_view(spark, sf_dir), TIMEOUT_US)


@query(duck(BASE + f" SELECT {ID}, initiator, CASE WHEN initiator = ep_a THEN ep_b ELSE ep_a END AS responder, start_us, end_us, fwd_packets, rev_packets, fwd_bytes, rev_bytes, fwd_syn, rev_ack, sizes, round(duration_s, 6) + 0.0 AS duration_s FROM ses"))
def flow_sessions(spark, sf_dir):
    out = sessions(spark, sf_dir).withColumn("sizes", F.concat_ws(",", F.transform("sizes", lambda x: x.cast("string"))))
    return rounded(out.select(*S.KEYS, "session", "initiator", "responder", "start_us", "end_us", "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "fwd_syn", "rev_ack", "sizes", "duration_s"))


@query(duck(BASE + f" SELECT {ID}, fwd_bytes AS egress_bytes, rev_bytes AS ingress_bytes, round(fwd_bytes / (rev_bytes + 1), 6) + 0.0 AS egress_ratio, round(8 * fwd_bytes / CASE WHEN duration_s > 0 THEN duration_s ELSE 1 END, 6) + 0.0 AS egress_bps FROM ses"))
def exfil_features(spark, sf_dir):
    return rounded(S.exfil_features(sessions(spark, sf_dir)).select(*S.KEYS, "session", "egress_bytes", "ingress_bytes", "egress_ratio", "egress_bps"))


@query(duck(BASE + f" SELECT {ID}, tls_ja3, array_to_string(list_concat(string_split(sizes, ','), list_transform(range(10), lambda x: '0'))[1:10], ',') AS pst FROM ses WHERE tls_ja3 IS NOT NULL"))
def tls_flow_features(spark, sf_dir):
    out = S.tls_flow_features(sessions(spark, sf_dir))
    return out.select(*S.KEYS, "session", "tls_ja3", F.concat_ws(",", F.transform("pst_sequence", lambda x: x.cast("string"))).alias("pst"))


REPEATS = f", again AS (SELECT {ID}, forward, tcp_seq, payload_len, count(*) - 1 AS again FROM r GROUP BY ALL), dup AS (SELECT ep_a, ep_b, protocol, CAST(session AS BIGINT) AS session, forward, CAST(sum(again) AS BIGINT) AS duplicates FROM again GROUP BY ALL)"


@query(duck(BASE + REPEATS + " SELECT * FROM dup"))
def tcp_duplicates(spark, sf_dir):
    return S.tcp_duplicates(session_view(spark, sf_dir), TIMEOUT_US)


LATE = """, lq AS (SELECT ep_a, ep_b, protocol, CAST(session AS BIGINT) AS session, forward, list({'q': tcp_seq, 'l': payload_len, 'r': rst, 'x': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)} ORDER BY place) AS p FROM r GROUP BY ALL),
 late AS (SELECT ep_a, ep_b, protocol, session, forward, list_reduce(p, lambda w, x: {'q': x.q, 'l': x.l, 'r': x.r, 'x': CASE WHEN w.x > 0 AND x.q < w.x AND NOT x.r THEN w.x WHEN x.q > 0 THEN greatest(w.x, x.q + greatest(x.l, 1)) ELSE w.x END,
   'n': w.n + CASE WHEN w.x > 0 AND x.q < w.x AND NOT x.r THEN 1 ELSE 0 END}, {'q': CAST(0 AS BIGINT), 'l': CAST(0 AS BIGINT), 'r': false, 'x': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}).n AS out_of_order FROM lq)"""


@query(duck(BASE + LATE + " SELECT * FROM late"))
def tcp_out_of_order(spark, sf_dir):
    return S.tcp_out_of_order(session_view(spark, sf_dir), TIMEOUT_US)


TCP = """, m AS (SELECT ep_a, ep_b, protocol, CAST(session AS BIGINT) AS session, place, forward, syn, ack, fin, rst, ts_us FROM r), q AS (
 SELECT ep_a, ep_b, protocol, session, list({'f': forward, 's': syn, 'a': ack, 'n': fin, 'r': rst, 't': ts_us} ORDER BY place) AS p FROM m GROUP BY ALL),
 tcp AS (SELECT ep_a, ep_b, protocol, session, CAST(len(p) AS BIGINT) AS packets, z.st AS state, z.hs AS handshake, round(z.rtt, 6) + 0.0 AS rtt_ms FROM (SELECT *, list_reduce(list_transform(p, lambda x: {'f': x.f, 's': x.s, 'a': x.a, 'n': x.n, 'r': x.r, 't': x.t, 'st': '', 'ff': false, 'rf': false, 'sy': CAST(NULL AS BIGINT), 'hs': false, 'rtt': CAST(NULL AS DOUBLE)}), lambda w, x: {
   'f': x.f, 's': x.s, 'a': x.a, 'n': x.n, 'r': x.r, 't': x.t,
   'st': CASE WHEN x.r THEN 'CLOSED' WHEN x.n AND (CASE WHEN x.f THEN w.rf ELSE w.ff END) THEN 'CLOSED' WHEN x.n THEN 'FIN_WAIT' WHEN w.st = 'SYN_SENT' AND x.f AND x.s AND NOT x.a THEN 'SYN_SENT' WHEN w.st = 'SYN_SENT' AND NOT x.f AND x.s AND x.a THEN 'SYN_RCVD'
      WHEN w.st = 'SYN_SENT' AND x.f AND NOT x.s THEN 'MIDSTREAM_ESTABLISHED' WHEN w.st = 'SYN_SENT' AND NOT x.f AND NOT x.s THEN 'HALF_OPEN_OBSERVED' WHEN w.st = 'SYN_RCVD' AND x.f AND x.a AND NOT x.s THEN 'ESTABLISHED' ELSE w.st END,
   'ff': w.ff OR (NOT x.r AND x.n AND x.f), 'rf': w.rf OR (NOT x.r AND x.n AND NOT x.f),
   'sy': CASE WHEN NOT x.r AND NOT x.n AND w.st = 'SYN_SENT' AND x.f AND x.s AND NOT x.a THEN x.t ELSE w.sy END,
   'hs': w.hs OR (NOT x.r AND NOT x.n AND w.st = 'SYN_RCVD' AND x.f AND x.a AND NOT x.s),
   'rtt': CASE WHEN NOT x.r AND NOT x.n AND w.st = 'SYN_RCVD' AND x.f AND x.a AND NOT x.s AND w.sy IS NOT NULL THEN (x.t - w.sy) / 1000 ELSE w.rtt END
 }, {'f': true, 's': false, 'a': false, 'n': false, 'r': false, 't': 0, 'st': 'SYN_SENT', 'ff': false, 'rf': false, 'sy': CAST(NULL AS BIGINT), 'hs': false, 'rtt': CAST(NULL AS DOUBLE)}) AS z FROM q))"""


@query(duck(BASE + TCP + " SELECT * FROM tcp"))
def tcp_state(spark, sf_dir):
    return rounded(S.tcp_state(session_view(spark, sf_dir), TIMEOUT_US))


@query(duck(BASE + f", x AS (SELECT *, lead(ts_us) OVER (PARTITION BY ep_a, ep_b, protocol ORDER BY ts_us, event_id) AS nx FROM k) SELECT event_id, ep_a, ep_b, protocol, ts_us AS last_us, ts_us + {TIMEOUT_US + 1} AS expired_us FROM x WHERE nx IS NULL OR nx - ts_us > {TIMEOUT_US}"))
def idle_expiry(spark, sf_dir):
    return S.idle_expiry(session_view(spark, sf_dir), TIMEOUT_US)


@query(duck(BASE + """, st AS (SELECT us, sum(d) AS d FROM (SELECT start_us AS us, 1 AS d FROM ses UNION ALL SELECT end_us + 1, -1 FROM ses) GROUP BY us)
 SELECT 'events' AS item, count(*) AS value FROM sv UNION ALL SELECT 'bytes', CAST(sum(length) AS BIGINT) FROM sv UNION ALL SELECT 'rejected', count(*) FILTER (WHERE NOT (src_port BETWEEN 0 AND 65535 AND dst_port BETWEEN 0 AND 65535 AND length >= 0)) FROM sv
 UNION ALL SELECT 'events_' || lower(protocol), count(*) FROM sv GROUP BY ALL UNION ALL SELECT 'peak_active', CAST(max(n) AS BIGINT) FROM (SELECT sum(d) OVER (ORDER BY us) AS n FROM st)"""))
def ingest_quality(spark, sf_dir):
    return S.ingest_quality(session_view(spark, sf_dir), sessions(spark, sf_dir))
