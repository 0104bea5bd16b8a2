"""Validation of events, alerts and blocks: each row gets the names of the rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

THREAT_CLASSES = ("VOLUMETRIC_DDOS", "C2_BEACONING", "DGA_DOMAIN", "DNS_TUNNELLING", "TLS_MALWARE", "PORT_SCANNING", "DATA_EXFILTRATION", "UNKNOWN_ANOMALY")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``violations``, the names of the rules that do not hold, in their order; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("violations", broken)


def validate_events(df: DataFrame) -> DataFrame:
    rules = {"src_port": F.col("src_port").between(0, 65535), "dst_port": F.col("dst_port").between(0, 65535), "length": F.col("length") >= 0}
    if "payload_entropy" in df.columns:
        rules["payload_entropy"] = F.col("payload_entropy").isNull() | F.col("payload_entropy").between(0, 8)
    return violations(df, rules)


def validate_alerts(df: DataFrame) -> DataFrame:
    """Alerts need a confidence in 0..1, evidence with named features, and known classes and severities."""
    named = F.forall("evidence", lambda e: F.length(F.trim(e["feature"])) > 0)
    return violations(df, {"confidence": F.col("confidence").between(0, 1), "evidence": F.size("evidence") > 0, "feature": named, "threat_class": F.col("threat_class").isin(*THREAT_CLASSES), "severity": F.col("severity").isin(*SEVERITIES)})


def validate_blocks(df: DataFrame) -> DataFrame:
    """Hashes are 64 hex digits, whatever their case."""
    hexed = lambda c: F.lower(F.col(c)).rlike("^[0-9a-f]{64}$")
    return violations(df, {c: hexed(c) for c in ("prev_block_hash", "merkle_root", "block_hash")})
