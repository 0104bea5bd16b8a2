"""A hash chain over alerts: leaves, Merkle roots of blocks, chained block hashes, and their audit.

A leaf is the SHA-256 of an alert's canonical JSON. Blocks hold ``size`` alerts in order of (ts_us, alert_id). A block's hash is
SHA-256 of the previous hash, its root, its time, a zero byte and its metadata. Roots are made for all blocks at once; only the
block hashes are a chain, over rows of 200 bytes, which run as one ordered stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

GENESIS = hashlib.sha256(b"SKEINFLOW_GENESIS").hexdigest()
METADATA = "{}"
RANGES = 64


def sha(data: Column) -> Column:
    return F.sha2(data, 256)


def leaf_hash(alerts: DataFrame) -> Column:
    return sha(F.to_json(F.struct(*sorted(alerts.columns))))


def merkle_root(leaves: Column) -> Column:
    """The root of an array of hex hashes, of any size: pairs are hashed, an odd last one with itself; of nothing, SHA-256 of
    nothing. As many folds as the size needs."""

    def up(layer: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(layer) - 1) / 2).cast("int")), lambda i: sha(F.unhex(F.concat(F.get(layer, i * 2), F.coalesce(F.get(layer, i * 2 + 1), F.get(layer, i * 2))))))
        return F.when(F.size(layer) > 1, pairs).otherwise(layer)

    folds = F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(2)).cast("double"))).cast("int") + 1  # one more than needed changes nothing
    top = F.aggregate(F.sequence(F.lit(1), folds), leaves, lambda layer, _: up(layer))
    return F.when(F.size(leaves) > 0, F.get(top, 0)).otherwise(F.lit(hashlib.sha256(b"").hexdigest()))


def block_hash(prev: Column, root: Column, time: Column, metadata: Column) -> Column:
    return sha(F.concat(F.unhex(prev), F.unhex(root), time.cast("binary"), F.unhex(F.lit("00")), metadata.cast("binary")))


def _chain(batches, genesis: str):
    prev = genesis
    names = ["block_height", "prev_block_hash", "block_hash"]
    for batch in batches:
        before, own = [], []
        for root, time, metadata in zip(*(batch.column(n).to_pylist() for n in ("merkle_root", "timestamp", "metadata"))):
            before.append(prev)
            prev = hashlib.sha256(bytes.fromhex(prev) + bytes.fromhex(root) + time.encode() + b"\x00" + metadata.encode()).hexdigest()
            own.append(prev)
        yield pa.RecordBatch.from_arrays([batch.column("block_height"), pa.array(before, pa.string()), pa.array(own, pa.string())], names)


def ordered_number(rows: DataFrame, order: list[str], ts: str) -> DataFrame:
    """``rows`` with ``n``, their place from 0 in the whole order: places within ranges of ``ts`` that hold about as many rows
    each, by quantiles, and the ranges' sums."""
    bounds = sorted(set(rows.approxQuantile(ts, [i / RANGES for i in range(1, RANGES)], 0.002)))
    ranged = rows.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(ts))) if bounds else F.lit(0))
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_c"))  # RANGES rows at most
    sums = sums.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(sums), "_range").withColumn("n", F.col("_base") + place).drop("_range", "_base")


def ledger_chain(alerts: DataFrame, size: int = 10, genesis: str = GENESIS, first_height: int = 0) -> DataFrame:
    """Blocks (block_height, prev_block_hash, merkle_root, timestamp, metadata, block_hash, leaves) of alerts with ts_us and
    alert_id; a block's time is that of its last alert. ``genesis`` and ``first_height`` go on with a chain."""
    rows = alerts.select("alert_id", "ts_us", leaf_hash(alerts).alias("leaf_hash"))
    rows = ordered_number(rows, ["ts_us", "alert_id"], "ts_us").withColumn("block_height", F.floor(F.col("n") / size).cast("long") + first_height)
    leaf = F.struct("n", "alert_id", "leaf_hash")
    blocks = rows.groupBy("block_height").agg(F.max("ts_us").alias("us"), F.array_sort(F.collect_list(leaf)).alias("l"))
    leaves = F.transform("l", lambda x: F.struct(x["alert_id"].alias("alert_id"), x["leaf_hash"].alias("leaf_hash")))
    time = F.date_format(F.expr("timestampadd(MICROSECOND, us, TIMESTAMP_NTZ '1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    blocks = blocks.select("block_height", merkle_root(F.transform("l", lambda x: x["leaf_hash"])).alias("merkle_root"), time.alias("timestamp"), F.lit(METADATA).alias("metadata"), leaves.alias("leaves"))
    heads = blocks.drop("leaves").repartition(1).sortWithinPartitions("block_height")
    chain = heads.mapInArrow(lambda b: _chain(b, genesis), "block_height long, prev_block_hash string, block_hash string")
    return blocks.join(chain, "block_height").select("block_height", "prev_block_hash", "merkle_root", "timestamp", "metadata", "block_hash", "leaves")


def verify_ledger(blocks: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """(block_height, errors): each block against the one before it and against its own contents."""
    low = blocks.agg(F.min("block_height").alias("_low"))
    heads = blocks.select((F.col("block_height") + 1).alias("block_height"), F.col("block_hash").alias("_prev"))
    rows = blocks.join(heads, "block_height", "left").crossJoin(F.broadcast(low))
    first = F.col("block_height") == F.col("_low")
    tests = {
        "height": first | F.col("_prev").isNotNull(), "previous_hash": F.col("prev_block_hash") == F.coalesce("_prev", F.when(first, F.lit(genesis)), "prev_block_hash"),
        "merkle_root": F.col("merkle_root") == merkle_root(F.transform("leaves", lambda x: x["leaf_hash"])),
        "block_hash": F.col("block_hash") == block_hash(F.col("prev_block_hash"), F.col("merkle_root"), F.col("timestamp"), F.col("metadata")),
    }
    return rows.select("block_height", F.concat_ws(",", *[F.when(~c, n) for n, c in tests.items()]).alias("errors"))


def alert_ledger_audit(alerts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(alert_id, status): sealed, altered (another leaf), unsealed (no leaf) or missing (no alert)."""
    own = alerts.select("alert_id", leaf_hash(alerts).alias("own"))
    leaves = blocks.select(F.explode("leaves").alias("l")).select(F.col("l.alert_id").alias("alert_id"), F.col("l.leaf_hash").alias("leaf"))
    status = F.when(F.col("own").isNull(), "missing").when(F.col("leaf").isNull(), "unsealed").when(F.col("own") == F.col("leaf"), "sealed").otherwise("altered")
    return own.join(leaves, "alert_id", "full_outer").select("alert_id", status.alias("status"))
