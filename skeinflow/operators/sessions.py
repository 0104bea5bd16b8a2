"""Bidirectional sessions of flow events, and what is read off them in order of time.

Events have ts_us, event_id, src_ip, src_port, dst_ip, dst_port, protocol, length and flags. A session is a run of events of
one pair of ends and protocol in which no gap is over the timeout; order is (ts_us, event_id).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tcp

KEYS = ["ep_a", "ep_b", "protocol"]
FLAGS = ("syn", "ack", "fin", "rst")


def with_ends(flows: DataFrame) -> DataFrame:
    """``flows`` with the two ends as texts in order."""
    src = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string"))
    dst = F.concat(F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"))
    return flows.withColumn("_src", src).withColumn("ep_a", F.least(src, dst)).withColumn("ep_b", F.greatest(src, dst))


def with_sessions(flows: DataFrame, timeout_us: int) -> DataFrame:
    """``flows`` with ends, the number of the session within them, the place in it, and whether its initiator sent the row."""
    order = Window.partitionBy(*KEYS).orderBy("ts_us", "event_id")
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    rows = with_ends(flows).withColumn("_new", F.when(gap <= timeout_us, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    own = Window.partitionBy(*KEYS, "session").orderBy("ts_us", "event_id")
    return rows.withColumn("place", F.row_number().over(own)).withColumn("forward", F.col("_src") == F.first("_src").over(own)).drop("_new")


def flow_sessions(flows: DataFrame, timeout_us: int, first_packets: int = 64) -> DataFrame:
    """One row per session: initiator, start, end, packets and bytes each way, the last value of each flag each way, and the
    signed sizes of the first packets."""
    rows = with_sessions(flows, timeout_us)
    fwd, rev = F.col("forward"), ~F.col("forward")
    when = lambda c, x: F.when(c, x)
    last = lambda flag, c: F.coalesce(F.max_by(when(c, F.col(flag)), when(c, F.col("place"))), F.lit(False))
    sizes = F.collect_list(F.when(F.col("place") <= first_packets, F.struct("place", F.when(fwd, F.col("length")).otherwise(-F.col("length")).alias("size"))))
    more = [last(f, c).alias(f"{n}_{f}") for f in FLAGS for n, c in (("fwd", fwd), ("rev", rev))]
    if "tls_ja3" in flows.columns:
        more.append(F.min_by("tls_ja3", F.when(F.col("tls_ja3").isNotNull(), F.col("place"))).alias("tls_ja3"))
    out = rows.groupBy(*KEYS, "session").agg(
        F.min_by("_src", "place").alias("initiator"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.count(when(fwd, 1)).alias("fwd_packets"), F.count(when(rev, 1)).alias("rev_packets"),
        F.sum(when(fwd, F.col("length")).otherwise(0)).alias("fwd_bytes"), F.sum(when(rev, F.col("length")).otherwise(0)).alias("rev_bytes"),
        *more, F.transform(F.array_sort(sizes), lambda x: x["size"]).alias("sizes"),
    )
    responder = F.when(F.col("initiator") == F.col("ep_a"), F.col("ep_b")).otherwise(F.col("ep_a"))
    return out.withColumn("responder", responder).withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)


def exfil_features(sessions: DataFrame) -> DataFrame:
    """Sessions with egress and ingress bytes, their ratio and the egress rate in bits a second."""
    egress, ingress = F.col("fwd_bytes"), F.col("rev_bytes")
    rate = 8 * egress / F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(1.0)
    return sessions.withColumn("egress_bytes", egress).withColumn("ingress_bytes", ingress).withColumn("egress_ratio", egress / (ingress + 1)).withColumn("egress_bps", rate)


def tls_flow_features(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Sessions with a fingerprint: it and the first ``n`` signed sizes, filled up with zeros."""
    sizes = F.slice(F.concat("sizes", F.array_repeat(F.lit(0).cast("long"), n)), 1, n)
    return sessions.where("tls_ja3 is not null").select(*KEYS, "session", "start_us", "initiator", "responder", "tls_ja3", sizes.alias("pst_sequence"))


def tcp_duplicates(flows: DataFrame, timeout_us: int) -> DataFrame:
    """Sessions and directions with their repeats of (tcp_seq, payload_len)."""
    rows = with_sessions(flows, timeout_us)
    seen = rows.groupBy(*KEYS, "session", "forward", "tcp_seq", "payload_len").agg((F.count("*") - 1).alias("again"))
    return seen.groupBy(*KEYS, "session", "forward").agg(F.sum("again").alias("duplicates"))


def _late_packets(batches):
    """Rows in order of session, direction and time -> late packets of each; one running number is all that is kept."""
    key, expected, late = None, 0, 0
    names = [*KEYS, "session", "forward", "out_of_order"]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.bool_(), pa.int64()]
    for batch in batches:
        done = []
        for *now, seq, length, rst in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key is not None:
                    done.append((*key, late))
                key, expected, late = now, 0, 0
            if expected > 0 and seq < expected and not rst:
                late += 1
            elif seq > 0:
                expected = max(expected, seq + max(length, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*done)] or [()] * 6, kinds)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*key, late), kinds)], names)


def tcp_out_of_order(flows: DataFrame, timeout_us: int) -> DataFrame:
    """Sessions and directions with the packets whose tcp_seq is below what was expected, resets aside.

    What is expected is the largest end, seq + max(payload_len, 1), of the packets that were not late. That is a fold, so the
    packets of a session run in order through one task, as a stream."""
    rows = with_sessions(flows, timeout_us).select(*KEYS, "session", "forward", "ts_us", "event_id", "tcp_seq", "payload_len", "rst")
    rows = rows.repartition(*KEYS, "session", "forward").sortWithinPartitions(*KEYS, "session", "forward", "ts_us", "event_id")
    packets = rows.select(*KEYS, "session", "forward", "tcp_seq", "payload_len", "rst")
    return packets.mapInArrow(_late_packets, "ep_a string, ep_b string, protocol string, session long, forward boolean, out_of_order long")


def tcp_state(flows: DataFrame, timeout_us: int) -> DataFrame:
    """The state machine of each session: state, handshake and round trip, by an ordered fold of the few packets that matter.

    Those are the first packet that leaves SYN_SENT and the forward SYN last before it, the first forward ACK after it, the
    first finish each way (flags), and the first and last of resets and finishes: the first ends the opening, and the state
    after the last depends on it and on those flags alone. Any other packet leaves everything as it is or is overwritten."""
    rows = with_sessions(flows.where("protocol = 'TCP'"), timeout_us)
    fwd, syn, ack, fin, rst = (F.col(c) for c in ("forward", "syn", "ack", "fin", "rst"))
    ends = rst | fin
    leaves = ends | ~syn | (~fwd & ack)
    before = Window.partitionBy(*KEYS, "session").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", F.coalesce(F.max(F.when(leaves, True)).over(before), F.lit(False)))
    packet = F.struct("place", "forward", "syn", "ack", "fin", "rst", "ts_us")
    first = lambda c: F.min(F.when(c, packet))
    last = lambda c: F.max(F.when(c, packet))
    kept = [first(leaves), last(fwd & syn & ~ack & ~F.col("_left")), first(F.col("_left") & fwd & ack & ~syn & ~ends), first(fin & ~rst & fwd), first(fin & ~rst & ~fwd), first(ends), last(ends)]
    lists = rows.groupBy(*KEYS, "session").agg(F.count("*").alias("packets"), F.array_sort(F.array_distinct(F.array_compact(F.array(*kept)))).alias("p"))
    folded = lists.withColumn("s", F.aggregate("p", tcp.start_state(), tcp.step))
    return folded.select(*KEYS, "session", "packets", F.col("s.state").alias("state"), F.col("s.handshake").alias("handshake"), F.col("s.rtt_ms").alias("rtt_ms"))


def idle_expiry(flows: DataFrame, timeout_us: int) -> DataFrame:
    """The last event of each session and the time from which its flow counts as expired."""
    order = Window.partitionBy(*KEYS).orderBy("ts_us", "event_id")
    after = F.lead("ts_us").over(order)
    rows = with_ends(flows).withColumn("_next", after).where((F.col("_next").isNull()) | (F.col("_next") - F.col("ts_us") > timeout_us))
    return rows.select("event_id", *KEYS, F.col("ts_us").alias("last_us"), (F.col("ts_us") + timeout_us + 1).alias("expired_us"))


def ingest_quality(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(item, value): events and bytes, by protocol, those that no rule accepts, and the largest number of sessions open at
    once (starts before ends of one time), by a sweep that sums per instant first and per hour before its running sum."""
    good = F.col("src_port").between(0, 65535) & F.col("dst_port").between(0, 65535) & (F.col("length") >= 0)
    totals = flows.agg(F.count("*").alias("events"), F.sum("length").alias("bytes"), F.sum(F.when(good, 0).otherwise(1)).cast("long").alias("rejected"))
    out = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("long").alias("value")) for c in ("events", "bytes", "rejected")])).alias("r")).select("r.*")
    out = out.unionAll(flows.groupBy(F.concat(F.lit("events_"), F.lower("protocol")).alias("item")).agg(F.count("*").alias("value")))
    steps = sessions.select(F.col("start_us").alias("us"), F.lit(1).alias("d")).unionAll(sessions.select((F.col("end_us") + 1).alias("us"), F.lit(-1).alias("d")))
    steps = steps.groupBy("us").agg(F.sum("d").alias("d")).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    hours = steps.groupBy("hour").agg(F.sum("d").alias("h"))
    hours = hours.select("hour", (F.sum("h").over(Window.orderBy("hour")) - F.col("h")).alias("base"))
    level = F.col("base") + F.sum("d").over(Window.partitionBy("hour").orderBy("us"))
    peak = steps.join(hours, "hour").select(level.alias("n")).agg(F.max("n").cast("long").alias("value")).select(F.lit("peak_active").alias("item"), "value")
    return out.unionAll(peak)
