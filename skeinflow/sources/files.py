"""Files whose bytes tasks read by themselves: Spark lists them, and each task opens its ranges through pyarrow's file systems
(local disks, HDFS and object stores by their URIs), so that no file has to fit into a row."""

from __future__ import annotations

import hashlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 1 << 20


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length) of files; nothing of their content is read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def located(path: str) -> tuple[FileSystem, str]:
    scheme, _, rest = path.rpartition(":") if "://" not in path else path.partition(":")
    return FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}") if scheme else FileSystem.from_uri(path)


def opened(path: str):
    """A file for reading at any place."""
    system, name = located(path)
    return system.open_input_file(name)


def file_ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """(path, length, low, high) of files (path, length): ranges of at most ``split_bytes``, one to a partition."""
    n = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    cut = files.where("length > 0").select("path", "length", low.alias("low"))
    return cut.withColumn("high", F.least("length", F.col("low") + split_bytes)).repartition(int(n), "path", "low")


def _digests(batches):
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            system, name = located(path)
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "sha256"])


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sha256) of files, each read as a stream of chunks; files are dealt out by their names, which the driver lists as
    for any scan. Empty files, which Spark's scans leave out, are among them."""
    names = [(unquote(f),) for f in spark.read.format("binaryFile").load(glob).inputFiles()]
    return spark.createDataFrame(names, "path string").repartition(max(1, len(names)), "path").mapInArrow(_digests, "path string, sha256 string")
