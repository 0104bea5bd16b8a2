"""Streaming twins of the flow operators: events with ts (timestamp) and the columns of the flow view.

All of them take a watermark; rows later than it are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ledger import GENESIS, ledger_chain
from ..operators.windows import domain_key, entropy_of
from ..functions.scalars import shannon_entropy
from ..plans.stages import new_path


def stamped(flows: DataFrame) -> DataFrame:
    """``flows`` with ts, the time of ts_us."""
    return flows.withColumn("ts", F.timestamp_micros("ts_us"))


def stream_flow_sessions(flows: DataFrame, timeout: str, watermark: str = "0 seconds") -> DataFrame:
    """Sessions, emitted once their timeout has passed in event time."""
    src = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string"))
    dst = F.concat(F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"))
    rows = flows.withColumn("_src", src).withColumn("ep_a", F.least(src, dst)).withColumn("ep_b", F.greatest(src, dst)).withWatermark("ts", watermark)
    out = rows.groupBy(F.session_window("ts", timeout).alias("w"), "ep_a", "ep_b", "protocol").agg(
        F.min_by("_src", F.struct("ts_us", "event_id")).alias("initiator"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return out.drop("w")


def _window(window: str, slide: str | None):
    return (F.window("ts", window, slide) if slide else F.window("ts", window)).alias("w")


def stream_dst_features(flows: DataFrame, window: str, slide: str | None = None, watermark: str = "0 seconds") -> DataFrame:
    """By destination and window, which may slide: events, SYNs, ACKs, and the exact entropy of sources, by two chained
    aggregations of the same windows."""
    rows = flows.withWatermark("ts", watermark)
    by_source = rows.groupBy(_window(window, slide), "dst_ip", "src_ip").agg(F.count("*").alias("c"), F.sum(F.col("syn").cast("long")).alias("syn"), F.sum(F.col("ack").cast("long")).alias("ack"))
    out = by_source.groupBy("w", "dst_ip").agg(F.sum("c").alias("n"), F.sum("syn").alias("syn"), F.sum("ack").alias("ack"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("clogc"))
    return out.select(F.unix_micros("w.start").alias("window_us"), "dst_ip", "n", "syn", "ack", entropy_of(F.col("n"), F.col("clogc")).alias("src_entropy"))


def stream_src_features(flows: DataFrame, window: str, slide: str | None = None, watermark: str = "0 seconds", approximate: bool = False) -> DataFrame:
    """By source and window, which may slide: events, SYNs, and distinct ports and destinations.

    Spark refuses exact distinct counts in a stream, so a first aggregation keeps each port and each address of a source and
    window once, and a second one counts them. ``approximate`` keeps a sketch for each source instead (1 % off, and state that
    does not grow with the ports)."""
    rows = flows.withWatermark("ts", watermark)
    syn = F.sum(F.col("syn").cast("long"))
    if approximate:
        sketch = lambda c: F.approx_count_distinct(c, 0.01).alias(f"{c}s")
        out = rows.groupBy(_window(window, slide), "src_ip").agg(F.count("*").alias("n"), syn.alias("syn"), sketch("dst_port"), sketch("dst_ip"))
    else:
        seen = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in ("dst_port", "dst_ip")]))
        once = rows.withColumn("_seen", seen).groupBy(_window(window, slide), "src_ip", F.col("_seen.kind").alias("kind"), F.col("_seen.value").alias("value")).agg(F.count("*").alias("c"), syn.alias("syn"))
        ports = F.col("kind") == "dst_port"
        there = F.col("value").isNotNull()
        out = once.groupBy("w", "src_ip").agg(F.sum(F.when(ports, F.col("c"))).alias("n"), F.sum(F.when(ports, F.col("syn"))).alias("syn"), F.count_if(ports & there).alias("dst_ports"), F.count_if(~ports & there).alias("dst_ips"))
    return out.select(F.unix_micros("w.start").alias("window_us"), "src_ip", "n", "syn", "dst_ports", "dst_ips")


def stream_domain_features(flows: DataFrame, window: str, watermark: str = "0 seconds") -> DataFrame:
    """By client, domain and window: queries, mean length, largest entropy and share of TXT queries."""
    rows = flows.where("dns_query is not null").withColumn("domain", domain_key(F.col("dns_query"), "parent")).withWatermark("ts", watermark)
    label = F.split_part("dns_query", F.lit("."), F.lit(1))
    out = rows.groupBy(F.window("ts", window).alias("w"), F.col("src_ip").alias("client"), "domain").agg(F.count("*").alias("queries"), F.avg(F.length("dns_query")).alias("avg_length"), F.max(shannon_entropy(label)).alias("max_entropy"), F.avg((F.col("dns_qtype") == "TXT").cast("double")).alias("txt_ratio"))
    return out.select(F.unix_micros("w.start").alias("window_us"), "client", "domain", "queries", "avg_length", "max_entropy", "txt_ratio")


def _beacon(key, frames, state):
    times, seen = state.get if state.exists else ([], 0)
    new = sorted(t for f in frames for t in f["ts_us"].tolist())
    times = sorted([*times, *new])[-64:]
    state.update((times, seen + len(new)))
    gaps = pd.Series([(b - a) / 1e6 for a, b in zip(times, times[1:]) if b - a > 50_000], dtype=float)
    enough = len(times) >= 4 and len(gaps) >= 3
    mean = float(gaps.mean()) if enough else 0.0
    std = float(gaps.std(ddof=0)) if enough else 0.0
    yield pd.DataFrame([[*key, seen + len(new), len(times), mean, std, std / mean if enough and mean else None]], columns=["src_ip", "dst_ip", "seen", "samples", "iat_mean", "iat_std", "iat_cv"])


def stream_pair_beacon(flows: DataFrame) -> DataFrame:
    """By host pair, after each micro-batch that has it: gap features of its newest 64 events, which are all its state."""
    return flows.select("src_ip", "dst_ip", "ts_us").groupBy("src_ip", "dst_ip").applyInPandasWithState(_beacon, "src_ip string, dst_ip string, seen long, samples long, iat_mean double, iat_std double, iat_cv double", "times array<long>, seen long", "update", "NoTimeout")


def _incident(key, frames, state):
    names = ["threat_class", "entity_id", "ts_us", "detections", "peak", "evidence"]
    if state.hasTimedOut:
        state.remove()
        return
    last, n, peak, evidence, first = state.get if state.exists else (None, 0, 0.0, "", 0)
    rows = pd.concat(list(frames)).sort_values(["ts_us", "confidence"], kind="stable")
    times, gap = rows["ts_us"].to_numpy(), int(rows["gap_us"].iloc[0])
    starts = np.append(last is None or times[0] - last > gap, np.diff(times) > gap)
    own = rows
    if starts.any():  # the state is that of the last incident
        at = int(np.flatnonzero(starts)[-1])
        own, n, peak, evidence, first = rows.iloc[at:], 0, 0.0, "", int(times[at])
    peak = max(peak, float(own["confidence"].max()))
    seen = {*filter(None, evidence.split(",")), *filter(None, ",".join(own["evidence"].fillna("")).split(","))}
    state.update((int(times[-1]), n + len(own), peak, ",".join(sorted(seen)), first))
    state.setTimeoutTimestamp(max((int(times[-1]) + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    new = rows[starts]
    yield pd.DataFrame({"threat_class": key[0], "entity_id": key[1], "ts_us": new["ts_us"], "detections": 1, "peak": new["confidence"].astype(float), "evidence": new["evidence"]}, columns=names)


def stream_incidents(detections: DataFrame, gap_us: int, watermark: str = "0 seconds") -> DataFrame:
    """The first detection of each incident of a class and entity, at once; repeats within the gap only raise its state, which
    leaves when the gap has passed. Input: ts, ts_us, threat_class, entity_id, confidence, evidence (text)."""
    rows = detections.select("ts", "ts_us", "threat_class", "entity_id", "confidence", "evidence", F.lit(gap_us).cast("long").alias("gap_us")).withWatermark("ts", watermark)
    return rows.groupBy("threat_class", "entity_id").applyInPandasWithState(_incident, "threat_class string, entity_id string, ts_us long, detections long, peak double, evidence string", "last long, n long, peak double, evidence string, first long", "append", "EventTimeTimeout")


def stream_alert_tail(alerts: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Alerts (alert_id, ts, ...) as they arrive, each id once within the watermark."""
    return alerts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["alert_id"])


def ledger_writer(path: str, size: int = 10):
    """A function for ``foreachBatch``: seals each micro-batch's alerts into blocks that go on from the last sealed one.

    A batch's blocks are one folder of ``<path>/blocks`` named by its id, and the head of the chain after it is one row of
    ``<path>/heads`` named likewise. A batch reads the head of the one before it and nothing else, and is written over if it
    runs again, so commits are idempotent and cost the same however long the chain is."""
    head = "block_height long, block_hash string"

    def commit(alerts: DataFrame, batch_id: int) -> None:
        spark = alerts.sparkSession
        last = spark.read.schema(head).parquet(f"{path}/heads/batch={batch_id - 1}").first() if batch_id else None
        height, prev = (last["block_height"] + 1, last["block_hash"]) if last else (0, GENESIS)
        ledger_chain(alerts, size, prev, height).write.mode("overwrite").parquet(f"{path}/blocks/batch={batch_id}")
        sealed = spark.read.parquet(f"{path}/blocks/batch={batch_id}")
        after = sealed.orderBy(F.desc("block_height")).select("block_height", "block_hash").limit(1)
        found = after.first() or (last and tuple(last))
        spark.createDataFrame([tuple(found)] if found else [], head).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/batch={batch_id}")

    return commit


def run_available(out: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. Update-mode streams write through ``foreachBatch``."""
    path, marks = new_path(spark, name), new_path(spark, f"{name}-marks")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path) if mode == "append" else spark.read.parquet(path).drop("batch")
