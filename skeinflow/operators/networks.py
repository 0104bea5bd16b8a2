"""Membership of addresses in networks, direction of flows, and look-ups by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import cidr_bounds, ip_to_long

#: Network tables up to this many rows are compared by a broadcast range join; larger ones by prefix buckets.
RANGE_JOIN_ROWS = 1000


def network_bounds(networks: DataFrame) -> DataFrame:
    """``networks`` (cidr, ...) with lo and hi; what is no block has no row."""
    low, high = cidr_bounds(F.col("cidr"))
    return networks.withColumn("lo", low).withColumn("hi", high).where("lo is not null")


def ip_in_networks(df: DataFrame, networks: DataFrame, ip: str, flag: str = "inside", large: bool | None = None) -> DataFrame:
    """``df`` with a boolean column: the address is in one of the blocks (false for what is no address).

    A few blocks are ranges against which a broadcast compares; many become (prefix length, prefix) keys, so that each
    address meets at most 33 hash look-ups, one for each prefix length that occurs."""
    bounds = network_bounds(networks).select("lo", "hi").distinct()
    if large is None:
        large = bounds.limit(RANGE_JOIN_ROWS + 1).count() > RANGE_JOIN_ROWS
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_n", ip_to_long(F.col("_ip"))).where("_n is not null")
    if large:
        keys = bounds.select((F.col("hi") - F.col("lo") + 1).alias("_size"), F.col("lo").alias("_lo"))
        sizes = keys.select("_size").distinct()  # 33 at most
        found = addresses.crossJoin(F.broadcast(sizes)).withColumn("_lo", F.col("_n") - F.col("_n") % F.col("_size")).join(keys, ["_size", "_lo"], "left_semi").select("_ip").distinct()
    else:
        near = F.broadcast(bounds)
        found = addresses.join(near, (F.col("_n") >= near.lo) & (F.col("_n") <= near.hi), "left_semi").select("_ip")
    return df.join(found.withColumn("_in", F.lit(True)), F.col(ip) == F.col("_ip"), "left").withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_ip", "_in")


def direction_of(src_in: Column, dst_in: Column) -> Column:
    return F.when(src_in & dst_in, "LATERAL").when(src_in, "OUTBOUND").when(dst_in, "INBOUND").otherwise("TRANSIT")


def classify_direction(flows: DataFrame, networks: DataFrame) -> DataFrame:
    """``flows`` with direction: which ends are in the internal networks."""
    both = ip_in_networks(ip_in_networks(flows, networks, "src_ip", "_src_in"), networks, "dst_ip", "_dst_in")
    return both.withColumn("direction", direction_of(F.col("_src_in"), F.col("_dst_in"))).drop("_src_in", "_dst_in")


def expect_direction(flows: DataFrame, expected: str, key: str) -> DataFrame:
    """By ``key``: events, those whose direction differs, and the first of these."""
    odd = F.col("direction") != expected
    return flows.groupBy(key).agg(F.count("*").alias("events"), F.sum(F.when(odd, 1).otherwise(0)).cast("long").alias("mismatches"), F.min(F.when(odd, F.col("event_id"))).alias("sample_id"))


def ja3_intel_join(flows: DataFrame, intel: DataFrame, fingerprint: str = "tls_ja3") -> DataFrame:
    """``flows`` with the family of a known fingerprint and its score, 0 where unknown."""
    known = intel.select(F.lower("ja3").alias("_ja3"), "family").dropDuplicates(["_ja3"])
    joined = flows.join(known, F.lower(F.col(fingerprint)) == F.col("_ja3"), "left").drop("_ja3")
    return joined.withColumn("ja3_score", F.when(F.col("family").isNotNull(), 0.95).otherwise(0.0))


def canonical_flow_key(flows: DataFrame, protocol: str = "protocol") -> DataFrame:
    """``flows`` with the ends of the flow in order, ep_a and ep_b, and the id of the direction seen."""
    one, two = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    shown = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port"), F.lit("_"), F.col("dst_ip"), F.lit(":"), F.col("dst_port"), F.lit("_"), F.col(protocol))
    return flows.withColumn("ep_a", F.least(one, two)).withColumn("ep_b", F.greatest(one, two)).withColumn("flow_id", shown)


def new_alerts(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    return alerts.join(seen.select("alert_id"), "alert_id", "left_anti")


def disjoint_splits(splits: DataFrame, split: str = "split", group: str = "grp") -> DataFrame:
    """(a, b, shared): the number of groups that two splits share, for each pair of train, val and test."""
    of = lambda s: splits.where(F.col(split) == s).select(group).distinct()
    out = None
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        row = of(a).intersect(of(b)).agg(F.count("*").alias("shared")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared")
        out = row if out is None else out.unionAll(row)
    return out
