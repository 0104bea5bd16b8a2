"""Readers of flow logs, ledgers, alerts and reference tables; every reader has a fixed schema and infers nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import file_digests
from ..functions.scalars import leftmost_label, parse_flow_port, parse_flow_state, parse_flow_time

FLOW_LOG = "StartTime string, Dur string, Proto string, SrcAddr string, Sport string, Dir string, DstAddr string, Dport string, State string, sTos string, dTos string, TotPkts string, TotBytes string, SrcBytes string, Label string"
BLOCK = "block_height long, prev_block_hash string, merkle_root string, timestamp string, metadata string, block_hash string, signature string, leaf_hashes array<struct<alert_id:string,leaf_hash:string>>"
ALERT = "alert_id string, timestamp string, threat_class string, severity string, confidence double, source struct<ip:string,port:int>, destination struct<ip:string,port:int>, evidence array<struct<feature:string,value:string,interpretation:string>>"


def flow_events(log: DataFrame) -> DataFrame:
    """Flow events and their labels of a labelled flow log (columns of ``FLOW_LOG``).

    A flow's length is its mean bytes a packet; what is no number counts as 0 bytes or 1 packet; flags are for TCP alone."""
    packets = F.coalesce(F.col("TotPkts").try_cast("long"), F.lit(1))
    size = F.coalesce(F.col("TotBytes").try_cast("long"), F.lit(0))
    proto = F.upper(F.trim("Proto"))
    flags = parse_flow_state(F.col("State"))
    of = lambda f: F.when(proto == "TCP", flags[f]).otherwise(False).alias(f)
    return log.select(
        parse_flow_time(F.col("StartTime")).alias("ts_us"), F.trim("SrcAddr").alias("src_ip"), parse_flow_port(F.coalesce("Sport", F.lit(""))).alias("src_port"), F.trim("DstAddr").alias("dst_ip"),
        parse_flow_port(F.coalesce("Dport", F.lit(""))).alias("dst_port"), proto.alias("protocol"), F.floor(size / F.greatest(packets, F.lit(1))).cast("long").alias("length"),
        F.when(F.col("Dir").contains("->"), "OUTBOUND").otherwise("LATERAL").alias("direction"), *[of(f) for f in ("syn", "ack", "fin", "rst", "psh", "urg")], F.coalesce("Label", F.lit("")).alias("label"),
    )


def read_flow_log(spark: SparkSession, path: str) -> DataFrame:
    return flow_events(spark.read.schema(FLOW_LOG).option("header", True).option("enforceSchema", True).csv(path))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a JSON-lines ledger as ``ledger.verify_ledger`` takes them: metadata is its text as written, object or string;
    malformed lines are skipped."""
    return spark.read.schema(BLOCK).option("mode", "DROPMALFORMED").json(path).withColumnRenamed("leaf_hashes", "leaves")


def write_ledger(blocks: DataFrame, path: str) -> None:
    """Blocks of ``ledger.ledger_chain`` as JSON lines."""
    blocks.withColumnRenamed("leaves", "leaf_hashes").write.json(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of a JSON-lines file; malformed lines are skipped."""
    return spark.read.schema(ALERT).option("mode", "DROPMALFORMED").json(path)


def read_domain_rank(spark: SparkSession, path: str) -> DataFrame:
    """(rank, domain, label) of a rank list."""
    rows = spark.read.schema("rank int, domain string").csv(path).where("rank is not null and domain is not null")
    return rows.withColumn("label", leftmost_label(F.col("domain")))


def read_ja3_intel(spark: SparkSession, path: str) -> DataFrame:
    """(ja3, family, first_seen) of a fingerprint feed whose comments start with #."""
    rows = spark.read.schema("ja3 string, family string, first_seen date").option("comment", "#").csv(path)
    return rows.withColumn("ja3", F.lower(F.trim("ja3"))).where(F.col("ja3").rlike("^[0-9a-f]{32}$"))


def file_checksum_audit(spark: SparkSession, glob: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """(name, status) of files, by the last part of their path or an expression of ``path``, against a manifest (name, sha256): ok, mismatch, unregistered or missing. Files are read in
    chunks where they are digested, whatever their size; a name that several files have is audited for each."""
    files = file_digests(spark, glob).select((F.element_at(F.split("path", "/"), -1) if name is None else name).alias("name"), F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unregistered").when(F.col("found") == F.lower("sha256"), "ok").otherwise("mismatch")
    return files.join(manifest.select("name", "sha256"), "name", "full_outer").select("name", status.alias("status"))
