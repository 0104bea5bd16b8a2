"""Templates in force: in a batch by both ways, and in a stream."""

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import templates as O
from skeinflow.plans.stages import new_path
from skeinflow.sources import netflow
from skeinflow.streaming import flows as S, stateful as T

DATA = "source_id long, template_id int, seq long, fields string, _row string, _mark string, _range string, from_seq string"


def brute(data, marks):
    out = []
    for s, t, q in data:
        own = sorted(dict(sorted((m[2], m[3]) for m in marks if m[:2] == (s, t) and m[3] is not None)).items())
        before = [m for m in own if q is not None and m[0] <= q]
        found = before[-1][1] if before else own[0][1] if own and q is not None else None
        out.append((s, t, q, found, "before" if before else "after" if found else "none"))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_join_equals_brute_force(spark, broadcast):
    data = [(s, t, q) for s in (1, 2, 3) for t in (256, 257) for q in range(0, 60, 1 + s)] + [(1, 256, 10), (1, 256, None), (None, 256, 4)]
    marks = [(1, 256, q, f"f{q // 10}") for q in range(5, 60, 5)] + [(2, 257, 30, "late"), (2, 257, 30, "a tie"), (2, 256, 0, None), (9, 256, 1, "other")]
    rows = spark.createDataFrame([(*d, "old", "r", "m", "x", "y") for d in data], DATA)
    templates = spark.createDataFrame(marks, "source_id long, template_id int, seq long, fields string")
    got = O.template_join(rows, templates, broadcast, size=7)
    assert got.columns == ["source_id", "template_id", "seq", "_row", "_mark", "_range", "from_seq", "fields", "resolution"]
    assert sorted((tuple(r[c] for c in ("source_id", "template_id", "seq", "fields", "resolution")) for r in got.collect()), key=str) == brute(data, marks)
    assert {tuple(r) for r in got.select("_row", "_mark", "_range", "from_seq").collect()} == {("r", "m", "x", "y")}
    none = O.template_join(rows, templates.limit(0), broadcast)
    assert {r["resolution"] for r in none.collect()} == {"none"}


def test_one_exporter_is_many_tasks(spark):
    """A million records of one exporter whose template changes every thousand: by ranges, in as many tasks as there are."""
    n, every = 1_000_000, 1000
    data = spark.range(n).select(F.lit(1).cast("long").alias("source_id"), F.lit(256).alias("template_id"), F.col("id").alias("seq"))
    marks = spark.range(0, n, every // 4).select(F.lit(1).cast("long").alias("source_id"), F.lit(256).alias("template_id"), (F.col("id") + 500).alias("seq"), F.floor(F.col("id") / every).cast("string").alias("fields"))
    assert O.template_intervals(marks).count() == n // every
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = O.template_join(data, marks, size=10_000).withColumn("task", F.spark_partition_id())
        right = F.floor(F.greatest(F.col("seq") - 500, F.lit(0)) / every).cast("string") == F.col("fields")
        tasks = found.groupBy("task").agg(F.count("*").alias("n"), F.count_if(~right).alias("wrong"), F.count_if(F.col("resolution") == "after").alias("after")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["n"] for r in tasks) == n and sum(r["wrong"] for r in tasks) == 0 and sum(r["after"] for r in tasks) == 500
    assert len(tasks) == 4 and max(r["n"] for r in tasks) < 0.5 * n


def test_few_templates_leave_the_data_in_place(spark):
    data = spark.range(100).select(F.lit(1).cast("long").alias("source_id"), F.lit(256).alias("template_id"), F.col("id").alias("seq"))
    plan = O.template_join(data, data.where("seq = 3").withColumn("fields", F.lit("f")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_orphan_counts(spark):
    data = spark.createDataFrame([(1, 256, q) for q in range(10)] + [(2, 256, 1)], "source_id long, template_id int, seq long")
    marks = spark.createDataFrame([(1, 256, 4, "f")], "source_id long, template_id int, seq long, fields string")
    assert {tuple(r) for r in O.orphan_counts(O.template_join(data, marks)).collect()} == {(1, 256, 10, 4, 0), (2, 256, 1, 1, 1)}


KIND = f"source_id long, template_id int, seq long, kind string, unix_secs long, uptime_ms long, fields {netflow.FIELDS}, body binary"


def streamed(spark, batches, **more):
    """The joined rows of a stream with these micro-batches."""
    T.keep_state_in_rocksdb(spark)
    path = new_path(spark, "in-templates")
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.run_available(T.stream_template_join(source, **more), spark, "templates")
    return {r["seq"]: (r["resolution"], r["fields"] and [tuple(f) for f in r["fields"]], bytes(r["body"])) for r in out.collect()}


def test_stream_with_a_late_template(spark):
    data = lambda q, s=1, secs=1000: (s, 256, q, "data", secs, 0, None, bytes([q]))
    mark = lambda q, n, secs=1000: (1, 256, q, "template", secs, 0, [(8, n)], None)
    found = streamed(spark, [[data(1), data(2), data(3)], [data(4), mark(5, 4), data(6)], [mark(8, 2), data(7), data(9)], [data(12), data(11), mark(13, 2)]])
    want = {1: "after", 2: "after", 3: "after", 4: "after", 6: "before", 7: "before", 9: "before", 11: "before", 12: "before"}
    assert {q: r[0] for q, r in found.items()} == want
    assert all(found[q][1] == [(8, 4 if q < 8 else 2)] and found[q][2] == bytes([q]) for q in want)


def test_stream_lets_orphans_go(spark):
    data = lambda q, s, secs: (s, 256, q, "data", secs, 0, None, b"x")
    found = streamed(spark, [[data(1, 7, 1000)], [data(2, 8, 9000)], [data(3, 8, 9001)], [data(4, 8, 9002)]], wait="10 minutes", shards=2)
    assert found == {1: ("none", None, b"x")}
