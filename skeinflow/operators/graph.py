"""Groups of rows that share values, directly or through others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.stages import discard, settle

#: Edges that a task contracts together.
CHUNK = 1 << 20
#: Parts into which the rows of a value are dealt.
SALTS = 64


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that edges a - b connect each with): every node takes the least of its neighbours' roots, then
    its root's root, until nothing changes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        for end in (i, j, root[i], root[j]):
            np.minimum.at(after, end, least)
        after = after[after]
        if (after == root).all():
            return nodes, nodes[root]
        root = after


def _contracted(batches):
    held, size = [], 0

    def forest(parts):
        nodes, roots = _roots(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        moved = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], ["a", "b"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= CHUNK:
            yield forest(held)
            held, size = [], 0
    if held:
        yield forest(held)


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes as ``edges`` (longs): each task replaces its edges by one for each of its nodes,
    to the smallest one that they connect it with."""
    return edges.select("a", "b").mapInArrow(_contracted, "a long, b long")


def propagate(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of edges (a, b) of longs. Each task first contracts the edges that it has; then every node points at a
    smaller neighbour's root and at its root's root, until nothing changes. A round is a written table of one row per node,
    which goes when the next one stands; the last one stays, as the result reads it."""
    near = contract(edges)
    both = settle(near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, "a").select("a", F.least("root", "near").alias("root"))
        jump = moved.select(F.col("a").alias("root"), F.col("root").alias("far"))
        after = settle(moved.join(jump, "root", "left").select("a", F.coalesce("far", "root").alias("root")), "labels")
        settled = after.join(labels.withColumnRenamed("root", "was"), "a").where("root <> was").isEmpty()
        discard(labels)
        labels = after
        if settled:
            discard(both)
            return labels.select(F.col("a").alias("node"), F.col("root").alias("component"))
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def shared_value_edges(values: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the keys k of each value of ``values`` (k, v), about one for each row. A value's keys are dealt
    into ``SALTS`` parts; each links to the part's smallest, and these to the value's, so that a value which most rows have
    is many tasks' work."""
    dealt = values.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    parts = dealt.groupBy("v", "s").agg(F.min("k").alias("m"))
    inside = dealt.join(parts, ["v", "s"]).where("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))
    least = parts.groupBy("v").agg(F.min("m").alias("first"))
    return inside.unionAll(parts.join(least, "v").where("m <> first").select(F.col("m").alias("a"), F.col("first").alias("b")))


def connected_groups(rows: DataFrame, key: str, attributes: list[str], least: int = 3) -> DataFrame:
    """(key, group): rows that share any attribute's value, directly or through others, have one group, its smallest key.

    Fewer than ``least`` groups are an error: a split needs that many. A null value is shared by none."""
    values = rows.select(F.col(key).cast("long").alias("k"), F.explode(F.array(*[F.struct(F.lit(a).alias("n"), F.col(a).cast("string").alias("v")) for a in attributes])).alias("v")).where("v.v is not null")
    found = propagate(shared_value_edges(values))
    out = rows.select(F.col(key)).join(found, F.col(key).cast("long") == F.col("node"), "left").select(key, F.coalesce("component", F.col(key).cast("long")).alias("group"))
    out = settle(out, "groups")
    discard(found)
    if out.select("group").distinct().limit(least).count() < least:
        raise ValueError(f"fewer than {least} groups: a split by group would leak")
    return out
