"""Tables written between stages, in the folder that every executor and the driver share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset: a temporary folder if the master is local, as in tests,
    else the warehouse, which is shared as well."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-skeinflow-")
        return _LOCAL["dir"]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: what follows starts from files that survive a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


def settle_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, settled; the tables that were settled on the way to it go once it is written."""
    _OPEN.append([])
    try:
        out = settle(make(), name)
    finally:
        made = _OPEN.pop()
    for path in made[:-1]:
        _delete(out.sparkSession, path)
    return out
