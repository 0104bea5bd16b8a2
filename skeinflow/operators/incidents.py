"""Incidents: detections of one class and entity whose gaps are at most ``gap_us``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

GAP_US = 60_000_000


def _numbered(rows: DataFrame, keys: list[str], ts: str, tie: list[str], gap) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(ts, *tie)
    new = F.when(F.col(ts) - F.lag(ts).over(order) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("incident", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def dedup_incidents(alerts: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """One row per incident: first and last time, detections, peak confidence, the severity and technique of the peak, and
    the latest evidence of each feature, in order of its name. Detections have evidence, as the detectors' alerts do."""
    rows = _numbered(alerts, ["threat_class", "entity_id"], "ts_us", ["confidence"], gap_us)
    keys = ["threat_class", "entity_id", "incident"]
    rows = rows.select(*keys, "ts_us", F.struct("confidence", "ts_us", "severity", "technique").alias("peak"), F.posexplode("evidence").alias("place", "e"))
    # by feature first; a detection counts with its first piece of evidence
    items = rows.groupBy(*keys, F.col("e.feature").alias("feature")).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum((F.col("place") == 0).cast("long")).alias("n"), F.max("peak").alias("peak"), F.max_by("e", F.struct("ts_us", "e.value")).alias("e"))
    out = items.groupBy(*keys).agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("detections"), F.max("peak").alias("peak"), F.array_sort(F.collect_list("e")).alias("evidence"))
    cluster = F.struct(F.lit("incident_cluster_size").alias("feature"), F.col("detections").cast("double").alias("value"), F.lit(1.0).alias("threshold"), F.lit("rule").alias("source"))
    out = out.withColumn("evidence", F.when(F.col("detections") > 1, F.concat("evidence", F.array(cluster))).otherwise(F.col("evidence")))
    alert_id = F.substring(F.sha2(F.concat_ws("|", "threat_class", "entity_id", "first_us"), 256), 1, 32)
    return out.select(alert_id.alias("alert_id"), "threat_class", "entity_id", "first_us", "last_us", "detections", F.col("peak.confidence").alias("confidence"), F.col("peak.severity").alias("severity"), F.col("peak.technique").alias("technique"), "evidence")


def incident_clusters(events: DataFrame, gap_s: float = 60.0) -> DataFrame:
    """(entity, first_ts, is_attack, alerts) of alert events (ts seconds, entity, is_attack)."""
    rows = _numbered(events, ["entity"], "ts", [], gap_s)
    return rows.groupBy("entity", "incident").agg(F.min("ts").alias("first_ts"), F.max("is_attack").alias("is_attack"), F.count("*").alias("alerts")).drop("incident")


def incident_operations(events: DataFrame, attack_start: float | None, hours: float, gap_s: float = 60.0) -> DataFrame:
    """One row: alerts, incidents, false incidents, those an hour, and seconds to the first true one."""
    found = incident_clusters(events, gap_s)
    first = F.min(F.when(F.col("is_attack"), F.col("first_ts")))
    ttd = F.lit(None).cast("double") if attack_start is None else F.greatest(F.lit(0.0), first - F.lit(attack_start))
    false = F.sum(F.when(F.col("is_attack"), 0).otherwise(1)).cast("long")
    out = found.agg(F.sum("alerts").cast("long").alias("alerts"), F.count("*").alias("incidents"), false.alias("false_incidents"), ttd.alias("seconds_to_detect"))
    return out.withColumn("false_per_hour", F.col("false_incidents") / F.lit(hours) if hours > 0 else F.lit(0.0))
