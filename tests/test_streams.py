"""Connections in a stream of several micro-batches: counts, timers, late rows; and the table of transitions."""

import itertools

from pyspark.sql import functions as F

from skeinflow.operators import sessions as X, tcp
from skeinflow.plans.stages import new_path
from skeinflow.streaming import flows as S, stateful as T

from .test_fixtures import FLOW, SEC, flow, handshake

BACK = {"src": "203.0.113.1", "sport": 443, "dst": "10.0.0.1", "dport": 4000}


def streamed(spark, batches, timeout=30 * SEC, watermark="0 seconds"):
    """Rows of the stream with these micro-batches, and the rows that were dropped as late."""
    T.keep_state_in_rocksdb(spark)
    path, sink = new_path(spark, "in-tcp"), new_path(spark, "out-tcp")
    for rows in batches:
        spark.createDataFrame(rows, FLOW).coalesce(1).write.mode("append").parquet(path)
    source = S.stamped(spark.readStream.schema(FLOW).option("maxFilesPerTrigger", 1).parquet(path))
    out = T.stream_tcp_state(source, timeout, watermark)
    query = out.writeStream.option("checkpointLocation", new_path(spark, "marks")).option("path", sink).format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    return spark.read.schema(out.schema).parquet(sink).collect(), late


def test_handshake_over_micro_batches(spark):
    rows, late = streamed(spark, [[r] for r in handshake()])
    assert late == 0
    assert [(r["state"], r["packets"], r["expired"]) for r in sorted(rows, key=lambda r: r["packets"])] == [("SYN_SENT", 1, False), ("SYN_RCVD", 2, False), ("ESTABLISHED", 3, False)]
    assert max(rows, key=lambda r: r["packets"])["rtt_ms"] == 40.0


def test_duplicates_and_late_packets_each_way(spark):
    batches = [
        [flow(1, 1, syn=True, seq=1000, payload=1000), flow(2, 2, seq=2000, payload=500)],
        [flow(3, 3, seq=2000, payload=500), flow(4, 3.5, seq=500, payload=10), flow(5, 4, seq=700, payload=10, ack=True, **BACK)],
        [flow(6, 5, seq=700, payload=10, ack=True, **BACK), flow(7, 6, seq=700, payload=10, ack=True, **BACK), flow(8, 7, seq=100, payload=1, ack=True, **BACK)],
    ]
    rows, _ = streamed(spark, batches)
    last = max(rows, key=lambda r: r["packets"])
    assert (last["fwd_duplicates"], last["rev_duplicates"]) == (1, 2)
    assert (last["fwd_out_of_order"], last["rev_out_of_order"]) == (2, 3)
    whole = spark.createDataFrame([r for b in batches for r in b], FLOW)
    again = {r["forward"]: r["duplicates"] for r in X.tcp_duplicates(whole, 30 * SEC).collect()}
    behind = {r["forward"]: r["out_of_order"] for r in X.tcp_out_of_order(whole, 30 * SEC).collect()}
    assert again == {True: 1, False: 2} and behind == {True: 2, False: 3}


def test_sessions_end_by_gap_and_by_timer(spark):
    other = {"src": "10.9.9.9", "dst": "203.0.113.9"}
    batches = [[flow(1, 1, syn=True, seq=5), flow(2, 100, ack=True, seq=5)], [flow(3, 105, ack=True, seq=9)], [flow(4, 500, **other)], [flow(5, 501, **other)], [flow(6, 502, **other)]]
    rows, _ = streamed(spark, batches)
    own = [r for r in rows if "10.0.0.1:4000" in (r["ep_a"], r["ep_b"])]
    assert {(r["start_us"] // SEC, r["packets"], r["state"]) for r in own if r["expired"]} == {(1, 1, "SYN_SENT"), (100, 2, "MIDSTREAM_ESTABLISHED")}
    assert all(r["fwd_duplicates"] == 0 for r in own)  # the second session knows nothing of the first


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    rows, late = streamed(spark, [[flow(1, 100, syn=True)], [flow(2, 101, ack=True)], [flow(3, 5, ack=True), flow(4, 102, ack=True)]], watermark="10 seconds")
    assert late == 1 and max(r["packets"] for r in rows) == 3


def test_both_readers_of_the_table_agree(spark):
    """Every state, finish bits and packet: column expressions against the table of integers."""
    table = tcp.machine()
    cases = [(s, a, b, *p) for s in tcp.STATES for a, b in itertools.product([False, True], repeat=2) for p in itertools.product([False, True], repeat=5)]
    rows = spark.createDataFrame(cases, "was string, fwd_fin boolean, rev_fin boolean, forward boolean, syn boolean, ack boolean, fin boolean, rst boolean")
    state = F.struct(F.col("was").alias("state"), "fwd_fin", "rev_fin", F.lit(1000).cast("long").alias("syn_us"), F.lit(False).alias("handshake"), F.lit(None).cast("double").alias("rtt_ms"))
    packet = F.struct(*tcp.FACTS, F.lit(3000).cast("long").alias("ts_us"))
    for r in rows.withColumn("after", tcp.step(state, packet)).collect():
        number, mark = table[4 * tcp.STATES.index(r["was"]) + r["fwd_fin"] + 2 * r["rev_fin"]][sum(r[f] << i for i, f in enumerate(tcp.FACTS))]
        after = r["after"]
        assert (after["state"], after["fwd_fin"], after["rev_fin"]) == (tcp.STATES[number // 4], bool(number & 1), bool(number & 2))
        assert after["handshake"] == (mark == "shake") and after["rtt_ms"] == (2.0 if mark == "shake" else None)
        assert after["syn_us"] == (3000 if mark == "open" else 1000)


def test_distinct_counts_in_a_stream(spark):
    rows = [flow(i, t, src=f"10.0.0.{i % 3}", dst=f"203.0.113.{i % 7}", dport=i % 11, syn=i % 2 == 0) for i, t in enumerate(range(0, 300, 2))] + [flow(999, 10_000)]
    path = new_path(spark, "in-src")
    spark.createDataFrame(rows, FLOW).coalesce(1).write.parquet(path)
    exact = S.run_available(S.stream_src_features(S.stamped(spark.readStream.schema(FLOW).parquet(path)), "60 seconds", "20 seconds"), spark, "src")
    rough = S.run_available(S.stream_src_features(S.stamped(spark.readStream.schema(FLOW).parquet(path)), "60 seconds", "20 seconds", approximate=True), spark, "src")
    from skeinflow.operators import windows as W

    batch = W.src_window_features(spark.read.parquet(path), 60 * SEC, 20 * SEC).where("window_us < 9000000000").select("window_us", "src_ip", "n", "syn", "dst_ports", "dst_ips")
    assert sorted(exact.collect()) == sorted(batch.collect())
    assert exact.columns == rough.columns and rough.count() == exact.count()


def test_incidents_over_micro_batches(spark):
    """The first detection of each incident at once, whatever the micro-batches; repeats within the gap are silent."""
    kind = "ts_us long, threat_class string, entity_id string, confidence double, evidence string"
    row = lambda t, e="a", c=0.8, v="x": (t * SEC, "DDOS", e, c, v)
    batches = [[row(100), row(130, c=0.9), row(100, "b", v=None)], [row(150), row(211), row(215)], [row(400, "b"), row(290), row(350)]]
    path = new_path(spark, "in-incidents")
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    source = S.stamped(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path))
    found = S.run_available(S.stream_incidents(source, 60 * SEC, "1 hour"), spark, "incidents").collect()
    assert {(r["entity_id"], r["ts_us"] // SEC, r["detections"]) for r in found} == {("a", 100, 1), ("b", 100, 1), ("a", 211, 1), ("a", 290, 1), ("b", 400, 1)}
