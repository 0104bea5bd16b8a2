"""Detector rules: a feature row -> score, evidence, severity, technique. One projection for each detector.

A rule is (evidence feature, value, threshold, condition, score). The rule score is the largest of those that hold; with a
model's probability the confidence is the larger of both, and a row that only the model finds gets the model as evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import fuse_score, pst_pattern_matches

#: The technique of each class where a detector has one alone.
TECHNIQUES = {"C2_BEACONING": "T1071.001", "DGA_DOMAIN": "T1568.002", "DNS_TUNNELLING": "T1071.004", "TLS_MALWARE": "T1071.001", "PORT_SCANNING": "T1046", "DATA_EXFILTRATION": "T1048.003"}


@dataclass(frozen=True)
class Rule:
    feature: str
    value: Column
    threshold: float
    condition: Column
    score: float


@dataclass(frozen=True)
class Thresholds:
    """Parameters of the detectors, with their defaults."""

    ddos: dict = field(default_factory=lambda: {"syn_ack_ratio": 5.0, "pps": 200.0, "src_entropy": 3.5, "entropy_pps": 100.0, "amplification": 8.0, "amp_pps": 50.0, "alert": 0.70, "min_n": 1})
    scan: dict = field(default_factory=lambda: {"ports": 15, "syn_ratio": 0.65, "ips": 10, "slow_ports": 8, "slow_window_s": 60.0, "alert": 0.70})
    beacon: dict = field(default_factory=lambda: {"samples": 21, "min_iat": 0.5, "max_iat": 3600.0, "rigid_cv": 0.20, "jitter_cv": 0.45, "acf": 0.70, "skip_cv": 0.80, "skip_acf": 0.30, "alert": 0.70})
    dga: dict = field(default_factory=lambda: {"min_label": 4, "perplexity": 80.0, "entropy": 3.5, "length": 15, "digits": 0.35, "alert": 0.70})
    tunnel: dict = field(default_factory=lambda: {"queries": 5, "avg_length": 35.0, "txt": 0.50, "entropy": 3.6, "alert": 0.70})
    tls: dict = field(default_factory=lambda: {"pairs": 1, "alert": 0.80})
    exfil: dict = field(default_factory=lambda: {"ratio": 3.0, "egress": 50_000, "slow_ratio": 2.0, "slow_egress": 10_000, "slow_s": 120.0, "alert": 0.70})


DEFAULTS = Thresholds()


def scored(features: DataFrame, cls: str, entity: Column, ts_us: Column, rules: list[Rule], alert: float, critical: float, names: tuple[str, str], technique: Column | None = None, ml: Column | None = None, guard: Column | None = None) -> DataFrame:
    """Alerts (ts_us, threat_class, entity_id, rule_score, confidence, severity, technique, evidence) of a feature table."""
    none = F.lit(None).cast("double")
    item = lambda r: F.struct(F.lit(r.feature).alias("feature"), r.value.cast("double").alias("value"), F.lit(float(r.threshold)).alias("threshold"), F.lit("rule").alias("source"))
    evidence = F.array_compact(F.array(*[F.when(r.condition, item(r)) for r in rules]))
    scores = [F.when(r.condition, r.score).otherwise(0.0) for r in rules]
    rule = F.greatest(*scores) if len(scores) > 1 else reduce(lambda a, b: b, scores)
    rows = features if guard is None else features.where(guard)
    rows = rows.withColumn("_e", evidence).withColumn("_r", rule).withColumn("_p", ml if ml is not None else none)
    confidence = fuse_score(F.col("_r"), F.col("_p"))
    model = F.array(F.struct(F.lit("model_probability").alias("feature"), F.col("_p").alias("value"), F.lit(alert).alias("threshold"), F.lit("model").alias("source")))
    found = F.when((F.size("_e") == 0) & (F.col("_p") >= alert), model).otherwise(F.col("_e"))
    out = rows.select(
        ts_us.alias("ts_us"), F.lit(cls).alias("threat_class"), entity.alias("entity_id"), F.col("_r").alias("rule_score"), confidence.alias("confidence"),
        F.when(confidence >= critical, names[0]).otherwise(names[1]).alias("severity"), (technique if technique is not None else F.lit(TECHNIQUES[cls])).alias("technique"), found.alias("evidence"),
    )
    return out.where((F.col("confidence") >= alert) & (F.size("evidence") > 0))


def c(name: str) -> Column:
    return F.col(name)


def detect_ddos(features: DataFrame, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    t = thresholds.ddos
    flood = (c("syn_ack_ratio") >= t["syn_ack_ratio"]) & (c("pps") >= t["pps"]) & (c("n") >= t["min_n"])
    spread = (c("src_entropy") >= t["src_entropy"]) & (c("pps") >= t["entropy_pps"])
    amplified = (c("amplification") >= t["amplification"]) & (c("pps") >= t["amp_pps"])
    rules = [Rule("syn_to_ack_ratio", c("syn_ack_ratio"), t["syn_ack_ratio"], flood, 0.90), Rule("incoming_pps", c("pps"), t["pps"], flood, 0.90), Rule("src_ip_entropy", c("src_entropy"), t["src_entropy"], spread, 0.85), Rule("udp_amplification", c("amplification"), t["amplification"], amplified, 0.92)]
    return scored(features, "VOLUMETRIC_DDOS", c("dst_ip"), c("window_us"), rules, t["alert"], 0.90, ("CRITICAL", "HIGH"), F.when(amplified, "T1498.002").otherwise("T1498.001"), ml)


def detect_port_scan(features: DataFrame, window_s: float, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    t = thresholds.scan
    many = c("syn_ratio") >= t["syn_ratio"]
    rules = [
        Rule("distinct_dst_ports", c("dst_ports"), t["ports"], (c("dst_ports") >= t["ports"]) & many, 0.92), Rule("distinct_dst_ips", c("dst_ips"), t["ips"], (c("dst_ips") >= t["ips"]) & many, 0.88),
        Rule("slow_scan_ports", c("dst_ports"), t["slow_ports"], (c("dst_ports") >= t["slow_ports"]) & F.lit(window_s >= t["slow_window_s"]), 0.75),
    ]
    return scored(features, "PORT_SCANNING", c("src_ip"), c("window_us"), rules, t["alert"], 0.85, ("HIGH", "MEDIUM"), ml=ml)


def detect_beacon(features: DataFrame, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    t = thresholds.beacon
    cv, acf = F.coalesce(c("iat_cv"), F.lit(1.0)), c("iat_autocorr")
    rigid = cv < t["rigid_cv"]
    jittered = ~rigid & (cv < t["jitter_cv"]) & (acf > t["acf"])
    guard = (c("samples") >= t["samples"]) & c("iat_mean").between(t["min_iat"], t["max_iat"]) & ~((cv > t["skip_cv"]) & (acf < t["skip_acf"]))
    rules = [Rule("iat_cv", cv, t["rigid_cv"], rigid, 0.92), Rule("iat_autocorr", acf, t["acf"], jittered, 0.85)]
    return scored(features, "C2_BEACONING", F.concat("src_ip", F.lit("->"), "dst_ip"), c("ts_us"), rules, t["alert"], 0.90, ("CRITICAL", "HIGH"), ml=ml, guard=guard)


def detect_dga(features: DataFrame, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    t = thresholds.dga
    length, entropy, digits, odd = c("label_length"), c("label_entropy"), c("digit_ratio"), c("perplexity")
    guard = (length >= t["min_label"]) & ((entropy >= 3) | (odd >= 50) | (length >= 14) | (digits >= 0.25))
    rules = [Rule("trigram_perplexity", odd, t["perplexity"], odd >= t["perplexity"], 0.88), Rule("label_entropy", entropy, t["entropy"], entropy >= t["entropy"], 0.82), Rule("digit_ratio", digits, t["digits"], (length >= t["length"]) & (digits >= t["digits"]), 0.80)]
    return scored(features, "DGA_DOMAIN", c("domain"), c("ts_us"), rules, t["alert"], 0.90, ("HIGH", "MEDIUM"), ml=ml, guard=guard)


def detect_dns_tunnel(features: DataFrame, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    t = thresholds.tunnel
    rules = [Rule("avg_query_length", c("avg_length"), t["avg_length"], c("avg_length") >= t["avg_length"], 0.90), Rule("txt_ratio", c("txt_ratio"), t["txt"], c("txt_ratio") >= t["txt"], 0.87), Rule("max_query_entropy", c("max_entropy"), t["entropy"], c("max_entropy") >= t["entropy"], 0.83)]
    return scored(features, "DNS_TUNNELLING", F.concat("client", F.lit("->"), "domain"), c("ts_us"), rules, t["alert"], 0.90, ("CRITICAL", "HIGH"), ml=ml, guard=c("queries") >= t["queries"])


def detect_tls(features: DataFrame, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    """Features: initiator, responder, ts_us, ja3_score (of a fingerprint look-up) and pst_sequence."""
    t = thresholds.tls
    rows = features.withColumn("_pairs", pst_pattern_matches(c("pst_sequence")))
    rules = [Rule("ja3_intel", c("ja3_score"), 0.95, c("ja3_score") >= 0.95, 0.95), Rule("packet_size_pairs", c("_pairs"), t["pairs"], c("_pairs") >= t["pairs"], 0.85)]
    return scored(rows, "TLS_MALWARE", F.concat("initiator", F.lit("->"), "responder"), c("ts_us"), rules, t["alert"], 0.90, ("CRITICAL", "HIGH"), ml=ml)


def detect_exfil(features: DataFrame, thresholds: Thresholds = DEFAULTS, ml: Column | None = None) -> DataFrame:
    t = thresholds.exfil
    fast = (c("egress_ratio") >= t["ratio"]) & (c("egress_bytes") >= t["egress"])
    slow = (c("egress_ratio") >= t["slow_ratio"]) & (c("duration_s") >= t["slow_s"]) & (c("egress_bytes") >= t["slow_egress"])
    rules = [Rule("egress_ratio", c("egress_ratio"), t["ratio"], fast, 0.90), Rule("slow_egress_ratio", c("egress_ratio"), t["slow_ratio"], slow, 0.80)]
    return scored(features, "DATA_EXFILTRATION", F.concat("initiator", F.lit("->"), "responder"), c("start_us"), rules, t["alert"], 0.88, ("CRITICAL", "HIGH"), ml=ml)
