"""Runs the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS are read from the environment, and BENCH_COPIES:
with more than one, the events are first written so many times over in a temporary folder, each copy with users and ids of its own."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))
HEADLINE = ["run_detectors", "dst_window_features", "src_window_features", "pair_features", "domain_features", "flow_sessions", "tcp_state", "detect_ddos", "dedup_incidents", "merkle_root"]


def copied(spark: SparkSession) -> str:
    """A folder with the tables of SF_DIR and COPIES times its events."""
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    for name in os.listdir(SF_DIR):
        if name != "events.parquet":
            os.symlink(os.path.join(SF_DIR, name), os.path.join(folder, name))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    most = events.agg(F.max("event_id"), F.max("user_id")).first()
    many = spark.range(COPIES).withColumnRenamed("id", "copy").crossJoin(events)
    many = many.withColumn("event_id", F.col("event_id") + F.col("copy") * (most[0] + 1)).withColumn("user_id", F.col("user_id") + F.col("copy") * (most[1] + 1))
    many.select(*events.columns).write.parquet(f"{folder}/events.parquet")
    return folder


def main() -> None:
    from skeinflow.catalog import QUERIES

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = copied(spark) if COPIES > 1 else SF_DIR
    seconds = {}
    QUERIES["dst_window_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "copies": COPIES, "events": events, "events_per_second_run_detectors": round(events / seconds["run_detectors"])}))
    spark.stop()


if __name__ == "__main__":
    main()
