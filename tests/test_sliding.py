"""Trailing windows as sweeps against the definition, and what they cost."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import sweeps, windows as W

KIND = "event_id long, ts_us long, src_ip string, dst_ip string, dst_port int, syn boolean, ack boolean"


def entropy(values):
    counts = Counter(values).values()
    return sum(-c / sum(counts) * math.log2(c / sum(counts)) for c in counts)


@pytest.mark.parametrize("window", [0, 5, 40, 10_000])
def test_equals_definition(spark, window):
    draw = random.Random(window)
    rows = [(i, draw.randrange(300), f"s{draw.randrange(4)}", f"d{draw.randrange(3)}", draw.randrange(5), draw.random() < 0.4, draw.random() < 0.3) for i in range(400)]
    rows += [(1000 + i, 50, "s1", "d1", 1, True, False) for i in range(5)] + [(2000, -70, "s1", "d1", 1, False, True)]
    flows = spark.createDataFrame(rows, KIND)
    dst = {r["event_id"]: r for r in W.dst_sliding_features(flows, window).collect()}
    src = {r["event_id"]: r for r in W.src_sliding_features(flows, window).collect()}
    for i, t, s, d, *_ in rows:
        near = [r for r in rows if r[3] == d and t - window <= r[1] <= t]
        assert (dst[i]["n"], dst[i]["syn"], dst[i]["ack"]) == (len(near), sum(r[5] for r in near), sum(r[6] for r in near))
        assert dst[i]["src_entropy"] == pytest.approx(entropy(r[2] for r in near), abs=1e-9)
        near = [r for r in rows if r[2] == s and t - window <= r[1] <= t]
        assert (src[i]["n"], src[i]["dst_ports"], src[i]["dst_ips"], src[i]["syn"]) == (len(near), len({r[4] for r in near}), len({r[3] for r in near}), sum(r[5] for r in near))


def test_null_keys_and_categories(spark):
    rows = [(1, 0, None, "d", 1, True, None), (2, 1, "s", None, None, None, None), (3, 2, "s", "d", None, True, True)]
    flows = spark.createDataFrame(rows, KIND)
    assert {(r["event_id"], r["n"], r["syn"], r["ack"]) for r in W.dst_sliding_features(flows, 10).collect()} == {(1, 1, 1, 0), (3, 2, 2, 1)}
    assert {(r["event_id"], r["n"], r["dst_ports"], r["dst_ips"], r["syn"]) for r in W.src_sliding_features(flows, 10).collect()} == {(2, 1, 0, 0, 0), (3, 2, 0, 1, 1)}
    assert W.dst_sliding_features(flows.limit(0), 10).collect() == []


def test_window_of_a_million_events(spark):
    """One destination, and every event in the window of the last: the figures by closed form."""
    n = 1_000_000
    flows = spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("ts_us"), F.concat(F.lit("s"), F.col("id") % 1000).alias("src_ip"), F.lit("d").alias("dst_ip"), F.lit(1).alias("dst_port"), (F.col("id") % 2 == 0).alias("syn"), F.lit(False).alias("ack"))
    found = W.dst_sliding_features(flows, n)
    wrong = found.where((F.col("n") != F.col("event_id") + 1) | (F.col("syn") != F.floor(F.col("event_id") / 2) + 1))
    assert wrong.count() == 0
    last = found.where(F.col("event_id") == n - 1).first()
    assert last["src_entropy"] == pytest.approx(math.log2(1000), abs=1e-9)


def test_running_sums(spark):
    rows = spark.createDataFrame([("a", t, t % 3 - 1) for t in range(-50, 50)] + [("b", 5, 7)], "k string, t long, x long")
    found = {(r["k"], r["t"]): r["sum_x"] for r in sweeps.running_sums(rows, ["k"], "t", ["x"], 8).collect()}
    assert found == {("a", t): sum(u % 3 - 1 for u in range(-50, t + 1)) for t in range(-50, 50)} | {("b", 5): 7}


@pytest.mark.parametrize("slide", [5, 10, 20])
def test_overlapping_windows(spark, slide):
    draw = random.Random(slide)
    rows = [(i, draw.randrange(100), f"s{draw.randrange(4)}", f"d{draw.randrange(3)}", draw.randrange(5), draw.random() < 0.4, False) for i in range(300)]
    flows = spark.createDataFrame(rows, KIND).select("*", F.lit("UDP").alias("protocol"), F.lit(10).cast("long").alias("length"))
    dst = {(r["window_us"], r["dst_ip"]): r for r in W.dst_window_features(flows, 20, slide_us=slide).collect()}
    src = {(r["window_us"], r["src_ip"]): r for r in W.src_window_features(flows, 20, slide_us=slide).collect()}
    for start in range(-20 + slide, 100, slide):
        inside = [r for r in rows if start <= r[1] < start + 20]
        for d in {r[3] for r in inside}:
            own, got = [r for r in inside if r[3] == d], dst.pop((start, d))
            assert (got["n"], got["syn"], got["udp_bytes_in"], got["udp_bytes_out"]) == (len(own), sum(r[5] for r in own), 10 * len(own), 0)
            assert got["src_entropy"] == pytest.approx(entropy(r[2] for r in own), abs=1e-9)
        for s in {r[2] for r in inside}:
            own, got = [r for r in inside if r[2] == s], src.pop((start, s))
            assert (got["n"], got["dst_ports"], got["dst_ips"], got["syn"]) == (len(own), len({r[4] for r in own}), len({r[3] for r in own}), sum(r[5] for r in own))
    assert not dst and not src
    with pytest.raises(ValueError):
        W.src_window_features(flows, 20, slide_us=7)
