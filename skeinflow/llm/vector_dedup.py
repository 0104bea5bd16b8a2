"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class before any comparison. A table hashes each class to the signs of k hyperplanes; k follows the
number of classes, so that a bucket of unlike vectors holds about ``SPREAD``, and the number of tables follows k, so that a
pair at the threshold is missed by all of them with a probability of ``MISS`` at most (closer pairs far less often).

Classes that share a bucket are compared by exact cosines in double precision. A pair counts in the first table whose
signatures agree, so that each link counts once, whatever the number of tables that find it; a bucket emits one number of
links for each class and the edges of a spanning forest, never its pairs. Buckets of over ``BLOCK`` classes are dealt out
as pairs of blocks.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing (n_links 0, a
component of their own); vectors of different lengths never link; rows with a null vec_id count as vectors and may link
others, their component is the smallest non-null id reachable; repeated rows are vectors of their own, which link; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .filters import only_keys
from .store import settle
from .vectors import matrices, runs, stored, unit, usable

THRESHOLD = 0.9
SPREAD = 16
MISS = 0.01
BLOCK = 2048
SEED = 60


def shape(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = min(31, max(6, round(math.log2(max(classes, 1) / SPREAD + 1))))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One int32 for each row and table."""
    planes = np.random.default_rng((SEED, x.shape[1])).standard_normal((x.shape[1], tables * 31))
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        signs = x @ planes[:, t * 31 : t * 31 + bits] > 0
        out[:, t] = signs @ (1 << np.arange(bits))
    return out


def _digests(batches):
    for batch in batches:
        vectors = batch.column("vector")
        digest = [hashlib.md5(np.array(v, "<f8").tobytes()).digest() if v is not None else None for v in vectors.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors, pa.array(digest, pa.binary())], ["vec_id", "vector", "digest"])


def _hashed(batches, bits: int, tables: int):
    """(id, n, vector) -> (tbl, sig, id, n, signs, vector) for every table; the signature also names the length."""
    for batch in batches:
        for rows, matrix in matrices(batch, "vector"):
            x = unit(matrix)
            found = signatures(x, bits, tables)
            picked = batch.take(pa.array(rows))
            signs = pa.array([r.tobytes() for r in found], pa.binary())
            for t in range(tables):
                sig = found[:, t].astype(np.int64) | (x.shape[1] << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(sig), picked.column("id"), picked.column("n"), signs, picked.column("vector")], ["tbl", "sig", "id", "n", "signs", "vector"])


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix."""
    edges, left = [], np.ones(len(near), bool)
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(near[i] & left):
                left[j] = False
                edges.append((i, int(j)))
                queue.append(int(j))
    return edges


def _links(batches, threshold: float):
    """Runs of one pair of blocks -> rows (a, b, links): a forest's edges (links 0), and numbers of links of a (b null)."""
    for run in runs(batches, ["tbl", "sig", "i", "j"]):
        if run.num_rows < 2:
            continue
        batch = run.combine_chunks().to_batches()[0]
        ids, n, block = (batch.column(c).to_numpy() for c in ("id", "n", "block"))
        t, i, j = (batch.column(c)[0].as_py() for c in ("tbl", "i", "j"))
        (_, matrix), = matrices(batch, "vector")
        x = unit(matrix)
        near = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), 512):
            near[at : at + 512] = x[at : at + 512] @ x.T >= threshold
        near |= near.T
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None]
        if not near.any():
            continue
        signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.int32).reshape(len(x), -1)[:, :t]
        links = np.zeros(len(x), np.int64)
        for a in np.flatnonzero(near.any(1)):
            b = np.flatnonzero(near[a])
            links[a] = n[b[~(signs[b] == signs[a]).any(1)]].sum()
        forest = _forest(near)
        at = np.flatnonzero(links)
        a = [*(ids[x] for x, _ in forest), *ids[at]]
        b = [*(int(ids[y]) for _, y in forest), *[None] * len(at)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*[0] * len(forest), *links[at]], pa.int64())], ["a", "b", "links"])


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) over all tables for distinct vectors (id, n, vector)."""
    bits, tables = shape(classes.count(), threshold)
    hashed = classes.select("id", "n", "vector").mapInArrow(lambda b: _hashed(b, bits, tables), f"tbl int, sig long, id long, n long, signs binary, vector {classes.schema['vector'].dataType.simpleString()}")
    blocks = hashed.groupBy("tbl", "sig").agg(F.ceil(F.count("*") / BLOCK).alias("m")).where("m > 1")
    keys = ["tbl", "sig", "i", "j"]
    bucket = F.xxhash64("tbl", "sig")
    # buckets of one block are together after the join; of the larger ones alone the vectors are dealt out again
    whole = hashed.join(blocks.hint("merge"), ["tbl", "sig"], "left").where("m is null").withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    split = only_keys(hashed, blocks, bucket, bucket).join(blocks.hint("merge"), ["tbl", "sig"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = [df.select(*keys, "block", "id", "n", "signs", "vector") for df in (whole, split.repartition(*keys))]
    return reduce(DataFrame.unionAll, (df.sortWithinPartitions(*keys).mapInArrow(lambda b: _links(b, threshold), "a long, b long, links long") for df in rows))


def vector_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(stored(vectors)).alias("vector"))
    part = F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0.0)).cast(stored(vectors)))  # -0.0 + 0.0 is 0.0
    rows = rows.withColumn("vector", part).mapInArrow(_digests, f"vec_id long, vector {stored(vectors)}, digest binary")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    # a class whose rows have no id at all gets one above all others, which no result shows
    unnamed = F.lit((1 << 63) - 1).cast("long") - F.pmod(F.xxhash64("digest"), F.lit(1 << 40))
    classes = settle(classes.withColumn("id", F.coalesce("id", unnamed)), "classes")
    links = settle(class_links(classes, threshold), "links")
    counted = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = connected_components(links.where("b is not null").select("a", "b"))
    found = classes.select("digest", "id", "n").join(counted, "id", "left").join(groups, F.col("id") == groups.node, "left")
    found = found.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    own = F.coalesce("component_id", "vec_id")
    named = F.when(own < F.lit((1 << 63) - (1 << 41)), own)
    out = rows.select("vec_id", "digest").join(found, "digest", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), named.alias("component_id"), F.coalesce(F.col("vec_id") == named, F.lit(False)).alias("kept"))
