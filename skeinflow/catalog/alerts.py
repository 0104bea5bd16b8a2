from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import alerts as A, incidents as I, networks as N
from ..plans.flow_view import DAY_US, duck
from . import detect as D, windows as WC
from .registry import query, rounded

#: Sequence of CTEs up to ``al``: the incidents of three detectors as alerts.
_RAW = WC.DST + WC.SRC + WC.DOMAIN + ", raw AS (" + " UNION ALL ".join(D.SQL[k] for k in ("ddos", "port_scan", "dns_tunnel")) + ")"
AL = _RAW + D.INCIDENTS[len(D.RAW) :] + """, al AS (SELECT alert_id, first_us AS ts_us, threat_class, severity, confidence, CASE WHEN threat_class = 'VOLUMETRIC_DDOS' THEN NULL ELSE split_part(entity_id, '->', 1) END AS src_ip,
 CASE threat_class WHEN 'VOLUMETRIC_DDOS' THEN entity_id WHEN 'DNS_TUNNELLING' THEN split_part(entity_id, '->', 2) END AS dst_ip, technique, evidence FROM alerts)"""


def alert_table(spark, sf_dir) -> DataFrame:
    found = D.detections(D.Inputs(spark, sf_dir), (D.ddos, D.port_scan, D.dns_tunnel))
    ends = F.split("entity_id", "->")
    flood = F.col("threat_class") == "VOLUMETRIC_DDOS"
    rows = I.dedup_incidents(found, 2 * DAY_US).withColumn("src_ip", F.when(~flood, F.get(ends, 0)))
    rows = rows.withColumn("dst_ip", F.when(flood, F.col("entity_id")).when(F.col("threat_class") == "DNS_TUNNELLING", F.get(ends, 1)))
    evidence = F.array_join(F.transform("evidence", lambda e: e["feature"]), ",")
    return rounded(rows.select("alert_id", F.col("first_us").alias("ts_us"), "threat_class", "severity", "confidence", "src_ip", "dst_ip", "technique", evidence.alias("evidence")))


COLUMNS = "alert_id, ts_us, threat_class, severity, confidence, src_ip, dst_ip, technique, evidence"
SINCE = 1_704_844_800_000_000


@query(duck(AL + f" SELECT {COLUMNS} FROM al WHERE threat_class LIKE '%SCAN%' AND confidence >= 0.8 AND severity = 'HIGH' AND src_ip LIKE '%10.1%' AND ts_us >= {SINCE}"))
def hunt(spark, sf_dir):
    return A.hunt(alert_table(spark, sf_dir), cls="scan", confidence=0.8, severity="high", src="10.1", since_us=SINCE)


@query(duck(AL + f" SELECT {COLUMNS} FROM al WHERE contains(alert_id, 'ab') OR contains(lower(concat_ws(' ', threat_class, severity, src_ip, dst_ip, technique, evidence)), 'ab')"))
def search_alerts(spark, sf_dir):
    return A.search_alerts(alert_table(spark, sf_dir).drop("ts_us", "confidence"), "AB").join(alert_table(spark, sf_dir).select("alert_id", "ts_us", "confidence"), "alert_id")


@query(duck(AL + " SELECT threat_class, count(*) AS n, round(count(*) / (SELECT count(*) FROM al), 6) + 0.0 AS share FROM al GROUP BY ALL"))
def threat_counts(spark, sf_dir):
    return rounded(A.counts(alert_table(spark, sf_dir), "threat_class"))


@query(duck(AL + " SELECT severity, count(*) AS n, round(count(*) / (SELECT count(*) FROM al), 6) + 0.0 AS share FROM al GROUP BY ALL"))
def severity_counts(spark, sf_dir):
    return rounded(A.counts(alert_table(spark, sf_dir), "severity"))


@query(duck(AL + " SELECT count(*) AS alerts, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS critical_high, round(avg(confidence), 6) + 0.0 AS mean_confidence, round(avg(CASE WHEN substr(alert_id, 1, 1) < '8' THEN 1 ELSE 0 END), 6) + 0.0 AS sealed_share FROM al"))
def alert_kpis(spark, sf_dir):
    rows = alert_table(spark, sf_dir)
    return rounded(A.alert_kpis(rows, rows.where(F.substring("alert_id", 1, 1) < "8")))


def _pairs(values: dict) -> str:
    return ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in values.items())


@query(duck(AL + f", m(threat_class, detector) AS (VALUES {_pairs(A.CLASS_DETECTORS)}), c AS (SELECT detector, count(alert_id) AS hits FROM m LEFT JOIN al USING (threat_class) GROUP BY ALL) SELECT detector, hits, CASE WHEN hits > 0 THEN 'triggered' ELSE 'armed' END AS state FROM c"))
def detector_hits(spark, sf_dir):
    return A.detector_hits(alert_table(spark, sf_dir))


@query(duck(AL + f", x AS (SELECT max(ts_us) // {DAY_US} * {DAY_US} AS last FROM al), s AS (SELECT unnest(range(last - 11 * {DAY_US}, last + 1, {DAY_US})) AS minute_us FROM x) SELECT s.minute_us, count(al.alert_id) AS n FROM s LEFT JOIN al ON al.ts_us // {DAY_US} * {DAY_US} = s.minute_us GROUP BY ALL"))
def alerts_per_minute(spark, sf_dir):
    return A.alerts_per_minute(alert_table(spark, sf_dir), 12, F.max("ts_us"), DAY_US)


@query(duck(AL + " SELECT alert_id, ts_us, threat_class, severity, greatest(0, (SELECT count(*) FROM al) - 25) AS remaining FROM al ORDER BY ts_us DESC, alert_id LIMIT 25"))
def latest_alerts(spark, sf_dir):
    return A.latest_alerts(alert_table(spark, sf_dir).select("alert_id", "ts_us", "threat_class", "severity"))


@query(duck(AL + " SELECT alert_id, ts_us, threat_class, severity FROM al WHERE severity IN ('CRITICAL', 'HIGH') OR NOT EXISTS (SELECT 1 FROM al WHERE severity IN ('CRITICAL', 'HIGH')) ORDER BY ts_us DESC, alert_id LIMIT 8"))
def triage_queue(spark, sf_dir):
    return A.triage_queue(alert_table(spark, sf_dir).select("alert_id", "ts_us", "threat_class", "severity"))


@query(duck(AL + " SELECT alert_id, ts_us, severity, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END AS severity_rank FROM al"))
def workbench_order(spark, sf_dir):
    return A.workbench_order(alert_table(spark, sf_dir).select("alert_id", "ts_us", "severity"))


@query(duck(AL + " SELECT threat_class, count(*) AS n FROM al GROUP BY ALL ORDER BY n DESC, threat_class LIMIT 1"))
def top_class(spark, sf_dir):
    return A.top_class(alert_table(spark, sf_dir))


@query(duck(AL + """, lv AS (SELECT alert_id, ts_us FROM al), sd AS (SELECT * FROM al WHERE substr(alert_id, 1, 1) < '8')
 SELECT lv.alert_id, lv.ts_us, coalesce(sd.threat_class, 'UNKNOWN_ANOMALY') AS threat_class, coalesce(sd.severity, 'INFO') AS severity, coalesce(sd.confidence, 0.5) + 0.0 AS confidence FROM lv LEFT JOIN sd ON sd.alert_id = lv.alert_id"""))
def collect_alerts(spark, sf_dir):
    rows = alert_table(spark, sf_dir)
    return A.collect_alerts(rows.select("alert_id", "ts_us"), rows.where(F.substring("alert_id", 1, 1) < "8"))


@query(duck(AL + f" SELECT {COLUMNS} FROM al WHERE substr(alert_id, 1, 1) >= '8'"))
def new_alerts(spark, sf_dir):
    rows = alert_table(spark, sf_dir)
    return N.new_alerts(rows, rows.where(F.substring("alert_id", 1, 1) < "8"))


TIME = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ')"


@query(duck(AL + f", m(threat_class, mitre) AS (VALUES {_pairs(A.CLASS_TECHNIQUES)}) SELECT alert_id, {TIME} AS timestamp, al.threat_class, severity, confidence, coalesce(src_ip, '') AS src_ip, coalesce(dst_ip, '') AS dst_ip, coalesce(mitre, '') AS mitre FROM al LEFT JOIN m ON m.threat_class = al.threat_class"))
def export_alert_csv(spark, sf_dir):
    return A.export_alert_csv(alert_table(spark, sf_dir))


@query(duck(AL + f""", m(threat_class, pattern) AS (VALUES {_pairs(A.CLASS_PATTERNS)}), x AS (SELECT al.*, pattern, {TIME} AS t, sha256('indicator|' || alert_id) AS h FROM al JOIN m ON m.threat_class = al.threat_class)
 SELECT alert_id, '{{"type":"indicator","spec_version":"2.1","id":"indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '","created":"' || t || '","modified":"' || t || '","name":"Alert: ' || threat_class
  || '","indicator_types":["malicious-activity"],"pattern":"' || pattern || '","pattern_type":"stix","valid_from":"' || t || '","confidence":' || CAST(floor(round(confidence * 100, 6)) AS INT) || ',"labels":["' || replace(lower(threat_class), '_', '-') || '"]}}' AS indicator FROM x"""))
def export_indicators(spark, sf_dir):
    return A.export_indicators(alert_table(spark, sf_dir))


@query(duck(AL + f", m(threat_class, technique) AS (VALUES {_pairs(A.CLASS_TECHNIQUES)}) SELECT m.technique, m.threat_class, least(count(al.alert_id), 100) AS score FROM m LEFT JOIN al ON al.threat_class = m.threat_class GROUP BY ALL"))
def attack_layer(spark, sf_dir):
    return A.attack_layer(alert_table(spark, sf_dir))


@query(duck(AL + " SELECT 'total' AS section, 'alerts' AS item, count(*) AS value FROM al UNION ALL SELECT 'class', threat_class, count(*) FROM al GROUP BY ALL UNION ALL SELECT 'critical', alert_id, ts_us FROM al WHERE severity = 'CRITICAL'"))
def incident_report(spark, sf_dir):
    return A.incident_report(alert_table(spark, sf_dir))


@query(duck(AL + " SELECT alert_id, CASE WHEN length(alert_id) = 32 AND confidence BETWEEN 0 AND 1 THEN '' ELSE 'x' END AS violations FROM al"))
def validate_alerts(spark, sf_dir):
    from ..functions.checks import validate_alerts as check

    rows = alert_table(spark, sf_dir).withColumn("evidence", F.transform(F.split("evidence", ","), lambda e: F.struct(e.alias("feature"))))
    return check(rows).select("alert_id", F.array_join("violations", ",").alias("violations"))
