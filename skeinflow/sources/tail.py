"""Files of lines that grow, as a stream: what was appended since the last micro-batch.

Spark's file streams see a file once. This source's offsets are places in files - for each, the end of its last whole line -
and a micro-batch's partitions are ranges of bytes between two of them, so lines are read in tasks, each once, and a line
that is still being written waits until it ends.
"""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import located, opened, qualified
from .flow_logs import ALERT, BLOCK

LINE = "file string, place long, value string"
SPLIT_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int
    first: bool


def last_line_end(path: str, length: int, known: int) -> int:
    """The place after the last line end of a file, from ``known`` on."""
    with opened(path) as file:
        high = length
        while high > known:
            low = max(known, high - BLOCK_BYTES)
            at = file.read_at(high - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return known


def lines_of(part: Range):
    """(place, line) of the lines that begin in a range, the first of them after a line end unless the range has its begin."""
    with opened(part.path) as file:
        at, rest = part.low, b""
        if not part.first:
            at -= 1  # a line begins at ``low`` if one ends just before
            while at < part.high:
                block = file.read_at(min(BLOCK_BYTES, part.high - at), at)
                cut = block.find(b"\n")
                at += cut + 1 if cut >= 0 else len(block)
                if cut >= 0 or not block:
                    break
        place = at
        while place < part.high:
            block = file.read_at(BLOCK_BYTES, at)
            if not block:
                return
            at += len(block)
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if place >= part.high:
                    return
                yield place, line.removesuffix(b"\r")
                place += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        system, name = located(self.path)
        folder, _, pattern = name.rpartition("/")
        scheme = self.path[: len(self.path) - len(name)]
        found = system.get_file_info(FileSelector(folder, allow_not_found=True))
        return {scheme + f.path: f.size for f in found if f.type == FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and f.base_name[0] not in "._"}

    def latestOffset(self, start: dict | None = None, limit=None) -> dict:
        known = dict(start or getattr(self, "known", {}))
        self.known = known | {path: last_line_end(path, length, known.get(path, 0)) for path, length in self._files().items() if length > known.get(path, 0)}
        return self.known

    def partitions(self, start: dict, end: dict):
        return [Range(path, low, min(low + self.split, high), low == start.get(path, 0)) for path, high in sorted(end.items()) for low in range(start.get(path, 0), high, self.split)]

    def read(self, part: Range):
        places, values, size = [], [], 0
        for place, line in lines_of(part):
            places.append(place)
            values.append(line.decode("utf-8", "replace"))
            size += len(line)
            if size > BLOCK_BYTES:
                yield self._batch(part, places, values)
                places, values, size = [], [], 0
        yield self._batch(part, places, values)

    def _batch(self, part: Range, places: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], ["file", "place", "value"])

    def commit(self, end: dict) -> None:
        pass


class TailedLines(DataSource):
    """``spark.readStream.format("tailed_lines").load(path)``; the last part of the path may be a pattern."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def tail_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream (file, place, value) of the lines of files that grow; files may be added, and only grow."""
    spark.dataSource.register(TailedLines)
    return spark.readStream.format("tailed_lines").option("split", split_bytes).load(qualified(spark, path))


def _tail_json(spark: SparkSession, path: str, schema: str, key: str, split_bytes: int) -> DataFrame:
    rows = tail_lines(spark, path, split_bytes).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.select("r.*").where(F.col(key).isNotNull())


def tail_alerts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alerts of JSON-lines files as they are appended, with ``ts``, their time; malformed lines are skipped."""
    return _tail_json(spark, path, ALERT, "alert_id", split_bytes).withColumn("ts", F.try_to_timestamp("timestamp"))


def tail_ledger(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Blocks of a JSON-lines ledger as they are appended, as ``flow_logs.read_ledger`` gives them."""
    return _tail_json(spark, path, BLOCK, "block_hash", split_bytes).withColumnRenamed("leaf_hashes", "leaves")


def json_line(values: dict) -> str:
    """A line of such a file."""
    return json.dumps(values, separators=(",", ":"), sort_keys=True) + "\n"
