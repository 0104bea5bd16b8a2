"""Counters of what was read, what became events and why the rest did not: the same expressions for a table and for a stream.

A stream carries them as observed metrics: each micro-batch reports its own with its progress, and a listener adds them up
while the stream runs, without a pass of its own.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def frame_counters() -> list[Column]:
    """Of events of ``captures.decode_frames``: packets read and parsed, the causes of drops, bytes, and kinds of packets."""
    why, l4 = F.col("status"), F.col("l4_proto")
    count = {
        "packets_read": F.lit(True), "packets_parsed": why == "ok", "dropped_fragments": why == "fragment", "dropped_link": why == "link", "dropped_non_ip": why == "no_ip", "dropped_short": why == "short",
        "vlan_tagged": F.col("vlan"), "ipv4": ~F.contains("src_ip", F.lit(":")), "ipv6": F.contains("src_ip", F.lit(":")), "tcp": l4 == "TCP", "udp": l4 == "UDP", "icmp": l4 == "ICMP",
    }
    return [F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("bytes_read"), *[F.count_if(c).alias(n) for n, c in count.items()]]


def flowset_counters() -> list[Column]:
    """Of flowsets of ``netflow.netflow_flowsets``: flowsets of each kind, and those that were corrupt."""
    kind = F.col("kind")
    return [F.count_if(kind != "corrupt").alias("flowsets"), *[F.count_if(kind == k).alias(n) for k, n in (("template", "templates"), ("options", "options_templates"), ("data", "data_flowsets"), ("corrupt", "corrupt"))]]


def as_items(totals: DataFrame) -> DataFrame:
    """(item, value) of one row of counters."""
    return totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("long").alias("value")) for c in totals.columns])).alias("r")).select("r.*")


def counters(rows: DataFrame, expressions: list[Column]) -> DataFrame:
    """(item, value) over a table."""
    return as_items(rows.agg(*expressions))


class Totals(StreamingQueryListener):
    """The sums of a metric that streams observe under one name, over all micro-batches reported so far."""

    def __init__(self, name: str):
        self.name, self.values, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for item, value in (row.asDict() if row else {}).items():
            self.values[item] = self.values.get(item, 0) + (value or 0)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def observed(rows: DataFrame, expressions: list[Column], name: str) -> tuple[DataFrame, Totals]:
    """A stream that reports counters under ``name``, and the listener that adds them up, which listens from now on; it is
    taken away by ``stop_listening``."""
    totals = Totals(name)
    rows.sparkSession.streams.addListener(totals)
    return rows.observe(name, *expressions), totals


def stop_listening(spark: SparkSession, totals: Totals, wait_s: float = 30.0) -> DataFrame:
    """(item, value) once the stream has ended and its last progress has arrived."""
    totals.ended.wait(wait_s)
    spark.streams.removeListener(totals)
    return spark.createDataFrame(sorted(totals.values.items()), "item string, value long")
