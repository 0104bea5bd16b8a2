from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..plans.flow_view import DAY_US, duck, flow_view
from .registry import query, rounded

ENTROPY = "greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c))"
D = f"CAST(floor(ts_us / {DAY_US}) AS BIGINT) * {DAY_US}"

DST = f""", a AS (SELECT {D} AS window_us, dst_ip, src_ip, count(*) AS c, count(*) FILTER (WHERE syn) AS syn, count(*) FILTER (WHERE ack) AS ack, coalesce(sum(length) FILTER (WHERE protocol = 'UDP'), 0) AS udp FROM fv GROUP BY ALL),
 b AS (SELECT window_us, dst_ip, sum(c) AS n, sum(syn) AS syn, sum(ack) AS ack, {ENTROPY} AS h, sum(udp) AS ui FROM a GROUP BY ALL),
 o AS (SELECT {D} AS window_us, src_ip AS dst_ip, sum(length) AS uo FROM fv WHERE protocol = 'UDP' GROUP BY ALL),
 dst AS (SELECT b.window_us, b.dst_ip, CAST(n AS BIGINT) AS n, n / {DAY_US / 1e6} AS pps, CAST(syn AS BIGINT) AS syn, CAST(ack AS BIGINT) AS ack, syn / (ack + 1) AS syn_ack_ratio, h AS src_entropy, CAST(ui AS BIGINT) AS udp_bytes_in, CAST(coalesce(uo, 0) AS BIGINT) AS udp_bytes_out,
   CASE WHEN ui > 0 THEN ui / (coalesce(uo, 0) + 1) ELSE 0 END AS amplification FROM b LEFT JOIN o ON o.window_us = b.window_us AND o.dst_ip = b.dst_ip)"""
SRC = f""", src AS (SELECT {D} AS window_us, src_ip, count(*) AS n, count(DISTINCT dst_port) AS dst_ports, count(DISTINCT dst_ip) AS dst_ips, count(*) FILTER (WHERE syn) AS syn, count(*) FILTER (WHERE syn) / count(*) AS syn_ratio FROM fv GROUP BY ALL)"""
PAIR = """, k AS (SELECT src_ip, dst_ip, ts_us, row_number() OVER w AS r, (ts_us - lead(ts_us) OVER w) / 1e6 AS gap FROM fv WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts_us DESC, event_id DESC)),
 k2 AS (SELECT * FROM (SELECT src_ip, dst_ip, r, ts_us, CASE WHEN r < 64 AND gap > 0.05 THEN gap END AS gap FROM k WHERE r <= 64)),
 l AS (SELECT src_ip, dst_ip, count(*) AS samples, max(ts_us) AS last_us, count(gap) AS ng, avg(gap) AS m, stddev_pop(gap) AS s FROM k2 GROUP BY ALL),
 g AS (SELECT k2.src_ip, k2.dst_ip, gap - m AS c, row_number() OVER (PARTITION BY k2.src_ip, k2.dst_ip ORDER BY r DESC) AS i FROM k2 JOIN l USING (src_ip, dst_ip) WHERE gap IS NOT NULL),
 ac AS (SELECT src_ip, dst_ip, max(v) AS peak FROM (SELECT a.src_ip, a.dst_ip, b.i - a.i AS lag, sum(a.c * b.c) AS v FROM g a JOIN g b ON a.src_ip = b.src_ip AND a.dst_ip = b.dst_ip AND b.i - a.i BETWEEN 1 AND 9 GROUP BY ALL) GROUP BY ALL),
 pair AS (SELECT l.src_ip, l.dst_ip, samples, last_us, CASE WHEN ok THEN m ELSE 0 END AS iat_mean, CASE WHEN ok THEN s ELSE 0 END AS iat_std, CASE WHEN ok THEN s / m END AS iat_cv,
   CASE WHEN NOT ok OR ng < 4 THEN 0 WHEN s * s <= 1e-6 THEN 1 ELSE peak / (ng * s * s) END AS iat_autocorr FROM (SELECT *, samples >= 4 AND ng >= 3 AS ok FROM l) l LEFT JOIN ac ON ac.src_ip = l.src_ip AND ac.dst_ip = l.dst_ip)"""
LABEL_ENTROPY = "(SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split({x}, '')) AS ch) GROUP BY ch))"
DOMAIN = f""", e AS (SELECT label, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h FROM (SELECT label, ch, count(*) AS c FROM (SELECT label, unnest(string_split(label, '')) AS ch FROM (SELECT DISTINCT split_part(dns_query, '.', 1) AS label FROM fv WHERE dns_query IS NOT NULL)) GROUP BY ALL) GROUP BY label),
 q AS (SELECT src_ip AS client, regexp_replace(dns_query, '^[^.]*\\.', '') AS domain, dns_query, dns_qtype, h, ts_us, row_number() OVER (PARTITION BY src_ip, regexp_replace(dns_query, '^[^.]*\\.', '') ORDER BY ts_us DESC, event_id DESC) AS r FROM fv JOIN e ON e.label = split_part(dns_query, '.', 1)),
 dom AS (SELECT client, domain, count(*) AS queries, max(ts_us) AS last_us, avg(length(dns_query)) FILTER (WHERE r <= 50) AS avg_length, max(h) FILTER (WHERE r <= 50) AS max_entropy, count(*) FILTER (WHERE dns_qtype = 'TXT') / count(*) AS txt_ratio FROM q GROUP BY ALL)"""


def hop(by: str, window_us: int, slide_us: int) -> str:
    """The CTE ``hop``: features by destination or source over windows that overlap."""
    spread = f", ov AS (SELECT *, unnest(range(CAST(floor(ts_us / {slide_us}) AS BIGINT) * {slide_us} - {window_us - slide_us}, CAST(floor(ts_us / {slide_us}) AS BIGINT) * {slide_us} + 1, {slide_us})) AS window_us FROM fv)"
    if by == "src":
        return spread + ", hop AS (SELECT window_us, src_ip, count(*) AS n, count(*) FILTER (WHERE syn) AS syn, count(DISTINCT dst_port) AS dst_ports, count(DISTINCT dst_ip) AS dst_ips FROM ov GROUP BY ALL)"
    return spread + f""", oc AS (SELECT window_us, dst_ip, src_ip, count(*) AS c, count(*) FILTER (WHERE syn) AS syn, count(*) FILTER (WHERE ack) AS ack FROM ov GROUP BY ALL),
 hop AS (SELECT window_us, dst_ip, CAST(sum(c) AS BIGINT) AS n, CAST(sum(syn) AS BIGINT) AS syn, CAST(sum(ack) AS BIGINT) AS ack, {ENTROPY} AS src_entropy FROM oc GROUP BY ALL)"""


def R(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


@query(duck(DST + f" SELECT window_us, dst_ip, n, {R('pps')}, syn, ack, {R('syn_ack_ratio', 'src_entropy')}, udp_bytes_in, udp_bytes_out, {R('amplification')} FROM dst"))
def dst_window_features(spark, sf_dir):
    return rounded(W.dst_window_features(flow_view(spark, sf_dir), DAY_US))


@query(duck(SRC + f" SELECT window_us, src_ip, n, dst_ports, dst_ips, syn, {R('syn_ratio')} FROM src"))
def src_window_features(spark, sf_dir):
    return rounded(W.src_window_features(flow_view(spark, sf_dir), DAY_US))


@query(duck(hop("dst", DAY_US, DAY_US // 4) + f" SELECT window_us, dst_ip, n, syn, ack, {R('src_entropy')} FROM hop"))
def dst_overlapping_features(spark, sf_dir):
    return rounded(W.dst_window_features(flow_view(spark, sf_dir), DAY_US, slide_us=DAY_US // 4).select("window_us", "dst_ip", "n", "syn", "ack", "src_entropy"))


@query(duck(hop("src", DAY_US, DAY_US // 4) + " SELECT window_us, src_ip, n, syn, dst_ports, dst_ips FROM hop"))
def src_overlapping_features(spark, sf_dir):
    return W.src_window_features(flow_view(spark, sf_dir), DAY_US, slide_us=DAY_US // 4).drop("syn_ratio")


@query(duck(f", c AS (SELECT dst_ip, protocol, src_port % 16 AS p, count(*) AS c FROM fv GROUP BY ALL) SELECT dst_ip, protocol, CAST(sum(c) AS BIGINT) AS n, count(*) AS categories, round({ENTROPY}, 6) + 0.0 AS entropy FROM c GROUP BY ALL"))
def categorical_entropy(spark, sf_dir):
    flows = flow_view(spark, sf_dir).withColumn("p", F.col("src_port") % 16)
    return rounded(W.categorical_entropy(flows, ["dst_ip", "protocol"], "p"))


@query(duck(PAIR + f" SELECT src_ip, dst_ip, samples, {R('iat_mean', 'iat_std', 'iat_cv', 'iat_autocorr')} FROM pair"))
def pair_features(spark, sf_dir):
    return rounded(W.pair_features(flow_view(spark, sf_dir)).drop("last_us"))


@query(duck(PAIR + f" SELECT src_ip, dst_ip, {R('iat_autocorr')} FROM pair WHERE samples >= 8"))
def autocorr_peak(spark, sf_dir):
    return rounded(W.pair_features(flow_view(spark, sf_dir)).where("samples >= 8").select("src_ip", "dst_ip", "iat_autocorr"))


@query(duck(PAIR + f" SELECT src_ip, dst_ip, {R('iat_cv')}, coalesce(iat_cv < 0.22, false) AS rigid, coalesce(iat_cv < 0.38 AND iat_autocorr > 0.5, false) AS jittered FROM pair"))
def periodicity_flags(spark, sf_dir):
    return rounded(W.periodicity_flags(W.pair_features(flow_view(spark, sf_dir))).select("src_ip", "dst_ip", "iat_cv", "rigid", "jittered"))


@query(duck(DOMAIN + f" SELECT client, domain, queries, {R('avg_length', 'max_entropy', 'txt_ratio')} FROM dom"))
def domain_features(spark, sf_dir):
    return rounded(W.domain_features(flow_view(spark, sf_dir)).drop("last_us"))


SLIDE_DST = f""", p AS (SELECT a.event_id, b.src_ip, count(*) AS c, count(*) FILTER (WHERE b.syn) AS syn, count(*) FILTER (WHERE b.ack) AS ack FROM fv a JOIN fv b ON a.dst_ip = b.dst_ip AND b.ts_us BETWEEN a.ts_us - {DAY_US} AND a.ts_us GROUP BY ALL),
 s AS (SELECT event_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(syn) AS BIGINT) AS syn, CAST(sum(ack) AS BIGINT) AS ack, {ENTROPY} AS src_entropy FROM p GROUP BY ALL)"""


@query(duck(SLIDE_DST + " SELECT event_id, dst_ip, n, s.syn, s.ack, round(s.syn / (s.ack + 1), 6) + 0.0 AS syn_ack_ratio, round(src_entropy, 6) + 0.0 AS src_entropy FROM s JOIN (SELECT event_id, dst_ip FROM fv) USING (event_id)"))
def dst_sliding_features(spark, sf_dir):
    return rounded(W.dst_sliding_features(flow_view(spark, sf_dir), DAY_US))


@query(duck(f""" SELECT a.event_id, a.src_ip, count(*) AS n, count(DISTINCT b.dst_port) AS dst_ports, count(DISTINCT b.dst_ip) AS dst_ips, count(*) FILTER (WHERE b.syn) AS syn, round(count(*) FILTER (WHERE b.syn) / count(*), 6) + 0.0 AS syn_ratio
 FROM fv a JOIN fv b ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us - {DAY_US} AND a.ts_us GROUP BY ALL"""))
def src_sliding_features(spark, sf_dir):
    return rounded(W.src_sliding_features(flow_view(spark, sf_dir), DAY_US))


@query(duck(SLIDE_DST + ", t AS (SELECT event_id, dst_ip, n, s.syn, row_number() OVER (PARTITION BY dst_ip ORDER BY ts_us, event_id) AS r FROM s JOIN (SELECT event_id, dst_ip, ts_us FROM fv) USING (event_id)) SELECT event_id, dst_ip, n, syn FROM t WHERE r % 5 = 0"))
def sample_snapshots(spark, sf_dir):
    flows = flow_view(spark, sf_dir)
    rows = W.dst_sliding_features(flows, DAY_US).join(flows.select("event_id", "ts_us"), "event_id")
    return W.sample_snapshots(rows, ["ts_us", "event_id"], "dst_ip").select("event_id", "dst_ip", "n", "syn")


@query(duck(", l AS (SELECT src_ip AS key, max(ts_us) AS last_us FROM fv GROUP BY ALL) SELECT key, last_us, greatest(0, (SELECT count(*) FROM l) - 20) AS evicted FROM l ORDER BY last_us DESC, key LIMIT 20"))
def most_recent_keys(spark, sf_dir):
    return W.most_recent_keys(flow_view(spark, sf_dir), "src_ip", 20)


@query(duck(f""", c AS (SELECT {D} AS window_us, protocol, count(*) AS n FROM fv GROUP BY ALL),
 h AS (SELECT *, min(n) OVER w AS low, max(n) OVER w AS high FROM c WINDOW w AS (PARTITION BY protocol ORDER BY window_us ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
 SELECT window_us, protocol, n, low, high, round(CASE WHEN high > low THEN (n - low) / (high - low) ELSE 0 END, 6) + 0.0 AS scaled FROM h"""))
def count_history(spark, sf_dir):
    return rounded(W.count_history(flow_view(spark, sf_dir), DAY_US, "protocol"))
