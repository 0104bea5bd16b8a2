"""Files that grow, followed as a stream."""

import json

import pytest

from skeinflow.operators.ledger import GENESIS, verify_ledger
from skeinflow.plans.stages import new_path
from skeinflow.sources import tail as L
from skeinflow.streaming import flows as S


def follow(spark, stream, name):
    """A function that takes in what is there and returns all rows so far."""
    sink, marks = new_path(spark, name), new_path(spark, f"{name}-marks")

    def run():
        stream.writeStream.option("checkpointLocation", marks).option("path", sink).format("parquet").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(sink)

    return run


@pytest.mark.parametrize("split", [7, 1 << 20])
def test_lines_come_once_and_whole(spark, tmp_path, split):
    one, two = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    one.write_bytes(b"first\nsec")
    (tmp_path / "other.txt").write_bytes(b"no\n")
    run = follow(spark, L.tail_lines(spark, str(tmp_path / "*.jsonl"), split), "lines")
    values = lambda: sorted((r["file"].rpartition("/")[2], r["place"], r["value"]) for r in run().collect())
    assert values() == [("a.jsonl", 0, "first")]
    with open(one, "ab") as file:
        file.write(b"ond\r\n\n" + "ünïcode and a longer line\n".encode() + b"open")
    two.write_bytes(b"x\n" * 20)
    want = [("a.jsonl", 0, "first"), ("a.jsonl", 6, "second"), ("a.jsonl", 14, ""), ("a.jsonl", 15, "ünïcode and a longer line")] + [("b.jsonl", 2 * i, "x") for i in range(20)]
    assert values() == sorted(want)
    assert values() == sorted(want)  # nothing new
    with open(one, "ab") as file:
        file.write(b"ed\n")
    assert ("a.jsonl", 43, "opened") in values()


def test_long_lines_over_many_ranges(tmp_path):
    path = tmp_path / "long.txt"
    lines = [b"a" * n for n in (0, 3, 500, 1, 0, 80, 2)]
    path.write_bytes(b"\n".join(lines) + b"\n")
    reader = L.TailReader(str(path), 16)
    end = reader.latestOffset({})
    got = [line for part in reader.partitions({}, end) for _, line in L.lines_of(part)]
    assert got == lines


def test_alerts_are_tailed_once_each(spark, tmp_path):
    path = tmp_path / "alerts.jsonl"
    alert = lambda i: L.json_line({"alert_id": f"a{i}", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "threat_class": "DGA", "severity": "HIGH", "confidence": 0.9})
    path.write_text(alert(1) + "{broken\n" + alert(2))
    run = follow(spark, S.stream_alert_tail(L.tail_alerts(spark, str(path))), "alerts")
    assert sorted(r["alert_id"] for r in run().collect()) == ["a1", "a2"]
    with open(path, "a") as file:
        file.write(alert(2) + alert(3))
    assert sorted(r["alert_id"] for r in run().collect()) == ["a1", "a2", "a3"]


def test_ledger_is_tailed_and_verified(spark, tmp_path):
    from pyspark.sql import functions as F

    from skeinflow.operators.ledger import ledger_chain
    from skeinflow.sources import flow_logs

    alerts = spark.range(25).select(F.col("id").cast("string").alias("alert_id"), (F.col("id") * 1000).alias("ts_us"))
    flow_logs.write_ledger(ledger_chain(alerts), str(tmp_path / "ledger"))
    lines = sorted((line for f in (tmp_path / "ledger").glob("*.json") for line in f.read_text().splitlines()), key=lambda x: json.loads(x)["block_height"])
    path = tmp_path / "tailed.jsonl"
    path.write_text(lines[0] + "\n" + lines[1][:50])
    run = follow(spark, L.tail_ledger(spark, str(path)), "ledger")
    assert [r["prev_block_hash"] for r in run().collect()] == [GENESIS]
    path.write_text("\n".join(lines) + "\n")
    assert [r["errors"] for r in verify_ledger(run()).orderBy("block_height").collect()] == ["", "", ""]


def test_ledger_commits_read_the_last_head_alone(spark, tmp_path):
    """Batches, an empty one, and one that runs again: one chain; the heads before the last are not needed."""
    import shutil

    from pyspark.sql import functions as F

    path = str(tmp_path / "sealed")
    commit = S.ledger_writer(path, 10)
    alerts = lambda low, high: spark.range(low, high).select(F.col("id").cast("string").alias("alert_id"), (F.col("id") * 1000).alias("ts_us"))
    commit(alerts(0, 25), 0)
    commit(alerts(0, 0), 1)
    commit(alerts(25, 40), 2)
    shutil.rmtree(f"{path}/heads/batch=0")
    commit(alerts(25, 40), 2)
    commit(alerts(40, 41), 3)
    blocks = spark.read.parquet(f"{path}/blocks").drop("batch")
    assert [(r["block_height"], r["errors"]) for r in verify_ledger(blocks).orderBy("block_height").collect()] == [(i, "") for i in range(6)]
    assert blocks.select(F.sum(F.size("leaves"))).first()[0] == 41
