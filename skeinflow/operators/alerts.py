"""Queries, roll-ups and exports over a table of alerts: alert_id, ts_us, threat_class, severity, confidence, src_ip, dst_ip,
technique, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: For each class the technique that exports name, the pattern of its indicators and its detector; and the order of
#: severities.
CLASS_TECHNIQUES = {"VOLUMETRIC_DDOS": "T1498", "C2_BEACONING": "T1071", "DGA_DOMAIN": "T1568.002", "DNS_TUNNELLING": "T1071.004", "PORT_SCANNING": "T1046", "DATA_EXFILTRATION": "T1041", "TLS_MALWARE": "T1573"}
CLASS_PATTERNS = {
    "VOLUMETRIC_DDOS": "[network-traffic:dst_port > 0]", "C2_BEACONING": "[network-traffic:dst_ref.type = 'ipv4-addr']", "DGA_DOMAIN": "[domain-name:value MATCHES '[a-z0-9]{12,}']",
    "DNS_TUNNELLING": "[network-traffic:dst_port = 53]", "TLS_MALWARE": "[network-traffic:dst_port = 443]", "PORT_SCANNING": "[network-traffic:src_ref.type = 'ipv4-addr']",
    "DATA_EXFILTRATION": "[network-traffic:dst_bytes > network-traffic:src_bytes]",
}
CLASS_DETECTORS = {"VOLUMETRIC_DDOS": "ddos", "C2_BEACONING": "beacon", "DGA_DOMAIN": "dga", "DNS_TUNNELLING": "dga", "PORT_SCANNING": "scan", "DATA_EXFILTRATION": "exfil", "TLS_MALWARE": "tls"}
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}
MINUTE_US = 60_000_000


def lookup(values: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key), default)


def mapping(spark, values: dict, key: str, value: str) -> DataFrame:
    """A fixed table of the pairs."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias(key), F.lit(b).alias(value)) for a, b in values.items()]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def hunt(alerts: DataFrame, cls: str | None = None, confidence: float | None = None, op: str = ">=", severity: str | None = None, src: str | None = None, dst: str | None = None, since_us: int | None = None) -> DataFrame:
    """The alerts for which all that is given holds: class and addresses contain the text, severity is equal, confidence
    compares by ``op`` (= within 0.01), time is at or after ``since_us``."""
    value = F.col("confidence")
    compare = {">=": lambda v: value >= v, ">": lambda v: value > v, "<=": lambda v: value <= v, "<": lambda v: value < v, "=": lambda v: F.abs(value - v) < 0.01}
    if op not in compare:
        raise ValueError(f"no such comparison: {op}")
    tests = []
    if cls is not None:
        tests.append(F.upper("threat_class").contains(cls.upper()))
    if confidence is not None:
        tests.append(compare[op](confidence))
    if severity is not None:
        tests.append(F.col("severity") == severity.upper())
    tests += [F.col(c).contains(v) for c, v in (("src_ip", src), ("dst_ip", dst)) if v is not None]
    if since_us is not None:
        tests.append(F.col("ts_us") >= since_us)
    for t in tests:
        alerts = alerts.where(t)
    return alerts


def search_alerts(alerts: DataFrame, term: str) -> DataFrame:
    """The alerts whose record, as JSON, contains the term in any case."""
    return alerts.where(F.lower(F.to_json(F.struct("*"))).contains(term.lower()))


def counts(alerts: DataFrame, column: str) -> DataFrame:
    """(column, n, share) by value."""
    return alerts.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def alert_kpis(alerts: DataFrame, sealed: DataFrame) -> DataFrame:
    """One row: alerts, critical and high ones, mean confidence, share that ``sealed`` (alert_id) holds."""
    rows = alerts.join(sealed.select("alert_id", F.lit(1).alias("_s")).distinct(), "alert_id", "left")
    urgent = F.sum(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 1).otherwise(0)).cast("long")
    return rows.agg(F.count("*").alias("alerts"), urgent.alias("critical_high"), F.avg("confidence").alias("mean_confidence"), F.avg(F.coalesce("_s", F.lit(0)).cast("double")).alias("sealed_share"))


def detector_hits(alerts: DataFrame) -> DataFrame:
    """(detector, hits, state) of every detector, those without alerts too."""
    by = alerts.groupBy("threat_class").agg(F.count("*").alias("n"))
    rows = mapping(alerts.sparkSession, CLASS_DETECTORS, "threat_class", "detector").join(by, "threat_class", "left")
    return rows.groupBy("detector").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hits")).withColumn("state", F.when(F.col("hits") > 0, "triggered").otherwise("armed"))


def alerts_per_minute(alerts: DataFrame, minutes: int, now_us: Column | int, minute_us: int = MINUTE_US) -> DataFrame:
    """(minute_us, n) of the last ``minutes`` minutes up to that of ``now_us``, with zeros."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    last = F.floor(now / minute_us).cast("long") * minute_us
    spine = alerts.sparkSession.range(1) if isinstance(now_us, int) else alerts.agg(now.alias("_now"))
    last = last if isinstance(now_us, int) else F.floor(F.col("_now") / minute_us).cast("long") * minute_us
    spine = spine.where(last.isNotNull()).select(F.explode(F.sequence(last - (minutes - 1) * minute_us, last, F.lit(minute_us).cast("long"))).alias("minute_us"))
    by = alerts.groupBy((F.floor(F.col("ts_us") / minute_us).cast("long") * minute_us).alias("minute_us")).agg(F.count("*").alias("n"))
    return spine.join(by, "minute_us", "left").select("minute_us", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latest_alerts(alerts: DataFrame, n: int = 25) -> DataFrame:
    """The newest ``n``, with the number of those beyond."""
    total = alerts.agg(F.count("*").alias("_all"))
    return alerts.orderBy(F.desc("ts_us"), "alert_id").limit(n).crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("_all") - n)).drop("_all")


def triage_queue(alerts: DataFrame, n: int = 8) -> DataFrame:
    """The newest ``n`` critical or high alerts; without any, the newest of all."""
    urgent = F.col("severity").isin("CRITICAL", "HIGH")
    some = alerts.agg(F.coalesce(F.max(urgent), F.lit(False)).alias("_some"))
    rows = alerts.crossJoin(F.broadcast(some)).where(urgent | ~F.col("_some")).drop("_some")
    return rows.orderBy(F.desc("ts_us"), "alert_id").limit(n)


def workbench_order(alerts: DataFrame) -> DataFrame:
    """By severity, then newest first; ``severity_rank`` is the order of severities, unknown ones last."""
    return alerts.withColumn("severity_rank", lookup(SEVERITY_RANK, F.col("severity"), F.lit(9))).orderBy("severity_rank", F.desc("ts_us"), "alert_id")


def top_class(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("threat_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "threat_class").limit(1)


def collect_alerts(leaves: DataFrame, side: DataFrame) -> DataFrame:
    """One row per alert id of a ledger's leaves (alert_id, ts_us) and a side table of alerts: the side table's row if there
    is one, else a stub."""
    stub = leaves.select("alert_id", "ts_us", F.lit("UNKNOWN_ANOMALY").alias("threat_class"), F.lit("INFO").alias("severity"), F.lit(0.5).alias("confidence"), F.lit(1).alias("_p"))
    rows = side.select("alert_id", "ts_us", "threat_class", "severity", "confidence", F.lit(0).alias("_p")).unionByName(stub)
    first = Window.partitionBy("alert_id").orderBy("_p", "ts_us", "confidence")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_p")


def export_alert_csv(alerts: DataFrame) -> DataFrame:
    """The eight columns of the flat export."""
    time = F.date_format(F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ '1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return alerts.select("alert_id", time.alias("timestamp"), "threat_class", "severity", "confidence", F.coalesce("src_ip", F.lit("")).alias("src_ip"), F.coalesce("dst_ip", F.lit("")).alias("dst_ip"), lookup(CLASS_TECHNIQUES, F.col("threat_class"), F.lit("")).alias("mitre"))


def export_indicators(alerts: DataFrame) -> DataFrame:
    """(alert_id, indicator): a STIX 2.1 indicator as JSON. Ids are made from the alert's, so they are the same each time."""
    digest = F.sha2(F.concat(F.lit("indicator|"), F.col("alert_id")), 256)
    piece = lambda a, n: F.substring(digest, a, n)
    uid = F.concat_ws("-", piece(1, 8), piece(9, 4), piece(13, 4), piece(17, 4), piece(21, 12))
    time = export_alert_csv(alerts).select("alert_id", F.col("timestamp").alias("_t"))
    pattern = lookup(CLASS_PATTERNS, F.col("threat_class"), F.concat(F.lit("[x-alert:threat_class = '"), F.col("threat_class"), F.lit("']")))
    body = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uid).alias("id"), F.col("_t").alias("created"), F.col("_t").alias("modified"),
        F.concat(F.lit("Alert: "), F.col("threat_class")).alias("name"), F.array(F.lit("malicious-activity")).alias("indicator_types"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), F.col("_t").alias("valid_from"),
        F.floor(F.round(F.col("confidence") * 100, 6)).cast("int").alias("confidence"), F.array(F.replace(F.lower("threat_class"), F.lit("_"), F.lit("-"))).alias("labels"),
    )
    return alerts.join(time, "alert_id").select("alert_id", F.to_json(body).alias("indicator"))


def attack_layer(alerts: DataFrame) -> DataFrame:
    """(technique, threat_class, score): alerts by class, 100 at most, with zeros."""
    by = alerts.groupBy("threat_class").agg(F.count("*").alias("n"))
    rows = mapping(alerts.sparkSession, CLASS_TECHNIQUES, "threat_class", "technique").join(by, "threat_class", "left")
    return rows.select("technique", "threat_class", F.least(F.coalesce("n", F.lit(0)), F.lit(100)).cast("long").alias("score"))


def incident_report(alerts: DataFrame) -> DataFrame:
    """(section, item, value): totals, alerts by class, and the critical ones."""
    row = lambda s, item, v: (F.lit(s).alias("section"), item.alias("item"), v.cast("long").alias("value"))
    total = alerts.agg(F.count("*").alias("n")).select(*row("total", F.lit("alerts"), F.col("n")))
    by = alerts.groupBy("threat_class").agg(F.count("*").alias("n")).select(*row("class", F.col("threat_class"), F.col("n")))
    critical = alerts.where("severity = 'CRITICAL'").select(*row("critical", F.col("alert_id"), F.col("ts_us")))
    return total.unionByName(by).unionByName(critical)
