"""Centroid clustering with a vantage-point tree over the centroids.

Each round builds a tree over the centroids, broadcasts it, and assigns every vector by its own best-first branch and
bound: the node with the least bound first, until no bound reaches the best distance. A node's vantage point divides the
node's other centroids into a near and a far half; each half knows the smallest and largest distance of its members from that
point, which by the triangle inequality bounds how near they can be to a vector. A half is left out only if its bound is *over*
the best distance, never at it (the radius is inclusive, and wider by the rounding of the square roots), so every centroid
that ties is compared. Distances themselves are exact integers, and the smaller number wins a tie. A batch of vectors is searched together: each has its own bounds
and its own order, and those that stand before the same node share one product of matrices.

The vectors stay where they are. A task returns, for each centroid, the count and the sum of its vectors in that task, so a
cluster that holds most rows is summed where they lie, and what is shuffled has one row for each centroid and task. What is
collected or broadcast is the centroids, k x d numbers. Inertias come from one more pass of the same kind, as exact sums, so
no table is left behind.

Vectors become integers: floor(scale * x), x as double. Up to ``EXACT`` their distances are exact in doubles; vectors with
larger components are assigned with Python's integers, as exactly. A distance that does not fit a long is an error.

Defined results: vectors that are null, of another dimension, or with null or non-finite components take no part; zero
vectors do; a null vec_id takes part, but starts a centroid only after all others; repeated rows count each; with fewer
vectors than k there are fewer centroids, with none no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .vectors import matrices, stored

LEAF = 4
#: Components up to this have exact squared distances in doubles, in 2^11 dimensions: 2^11 * (2 * 2^20)^2 = 2^53.
EXACT = 1 << 20
#: Bounds are lowered by this share of the distances, more than the rounding of square roots.
SLACK = 1e-9
#: Rows that are searched together, times nodes.
CELLS = 1 << 22


def _objects(matrix) -> np.ndarray:
    """A matrix of Python's integers."""
    return np.array([[int(x) for x in row] for row in matrix], object)


class Tree:
    """A vantage-point tree over the rows of an integer matrix."""

    def __init__(self, centroids: list[list[int]]):
        self.rows = _objects(centroids)
        self.small = all(abs(x) <= EXACT for x in self.rows.flat)
        #: node -> (own centroids, [(child, least, largest distance of the child's members from the first of these)])
        self.nodes: list[tuple[list[int], list[tuple[int, float, float]]]] = []
        self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        here = len(self.nodes)
        if len(members) <= LEAF:
            self.nodes.append((members, []))
            return here
        self.nodes.append(([], []))
        point, *others = members
        square = {c: sum((x - y) ** 2 for x, y in zip(self.rows[c], self.rows[point])) for c in others}
        others.sort(key=lambda c: (square[c], c))
        half, children = len(others) // 2, []
        for part in (others[:half], others[half:]):
            children.append((self._build(sorted(part)), math.sqrt(square[part[0]]), math.sqrt(square[part[-1]])))
        self.nodes[here] = ([point], children)
        return here

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of the nearest centroid of each row of an integer matrix (float64 or objects)."""
        exact = vectors.dtype == object or not self.small
        vectors, centroids = (_objects(vectors), self.rows) if exact else (vectors, self.rows.astype(float))
        step = max(1, CELLS // len(self.nodes))
        parts = [self._search(vectors[i : i + step], centroids) for i in range(0, len(vectors), step)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0))

    def _squares(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return (rows * rows).sum(1)[:, None] - 2 * rows.dot(centroids.T) + (centroids * centroids).sum(1)[None, :]

    def _search(self, rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(rows)
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        number = np.full(n, len(self.rows))
        best = np.full(n, -1, object if rows.dtype == object else float)  # -1: none yet
        root = np.full(n, np.inf)
        active = np.arange(n)
        while len(active):
            at = bounds[active].argmin(1)
            going = np.isfinite(bounds[active, at]) & (bounds[active, at] <= root[active])
            active, at = active[going], at[going]
            for node in np.unique(at):
                here = active[at == node]
                own, children = self.nodes[node]
                came = bounds[here, node]
                bounds[here, node] = np.inf
                if not own:
                    continue
                square = self._squares(rows[here], centroids[own])
                for j, c in enumerate(own):
                    d, was = square[:, j], best[here]
                    better = (was < 0) | (d < was) | ((d == was) & (c < number[here]))
                    number[here[better]], best[here[better]] = c, d[better]
                    root[here[better]] = np.sqrt(d[better].astype(float))
                if children:
                    away = np.sqrt(square[:, 0].astype(float))
                    for child, low, high in children:
                        gap = np.maximum(low - away, away - high)
                        gap -= SLACK * (away + high)
                        bounds[here, child] = np.maximum(came, gap)
        return number, best


def integers(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as whole doubles where these are small enough, else as Python's integers."""
    scaled = matrix * scale
    if not matrix.size or np.abs(scaled).max() < EXACT:
        return np.floor(scaled)
    whole = lambda x: int(x) * scale if abs(x) >= 2**52 else math.floor(x * scale)
    return np.array([[whole(float(x)) for x in row] for row in matrix], object)


def kept_vectors(embeddings: DataFrame, dimension: int) -> DataFrame:
    """(vec_id long, vector) of the vectors with so many components, none null or non-finite."""
    vector = F.col("embedding").cast(stored(embeddings))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where((F.size("vector") == dimension) & ~bad)


def first_centroids(kept: DataFrame, k: int, salt: int, scale: int) -> list[list[int]]:
    """The k vectors of smallest sha256 of "salt:vec_id", in that order; k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select("vector", order.alias("order")).orderBy(F.asc_nulls_last("order"), "vector").limit(k).collect()
    return [[int(x) for x in integers(np.array([r["vector"]], float), scale)[0]] for r in rows]


def _assigned(batches, tree, scale: int):
    """(batch, its vectors as integers, numbers, squared distances)"""
    for batch in batches:
        for places, matrix in matrices(batch, "vector"):
            whole = integers(matrix, scale)
            yield batch.column(0).take(pa.array(places)), whole, *tree.value.nearest(whole)


def _sums(kept: DataFrame, tree, scale: int, k: int) -> DataFrame:
    """(cluster, n, sums, squares) over all vectors: exact decimals, summed first in each task."""
    # a decimal of 38 digits holds 10^19 vectors of components up to 2^62
    def run(batches):
        n, sums, squares = [0] * k, [0] * k, [0] * k
        for _, vectors, number, square in _assigned(batches, tree, scale):
            for c in np.unique(number):
                mine = number == c
                n[c] += int(mine.sum())
                sums[c] = sums[c] + np.array([int(x) for x in vectors[mine].sum(0)], object)
                squares[c] += sum(map(int, square[mine]))
        seen = [c for c in range(k) if n[c]]
        flat = [str(x) for c in seen for x in sums[c]]
        lists = pa.ListArray.from_arrays(pa.array(np.linspace(0, len(flat), len(seen) + 1).astype(np.int32)), pa.array(flat, pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([n[c] for c in seen], pa.int64()), lists, pa.array([str(squares[c]) for c in seen], pa.string())], ["cluster", "n", "sums", "squares"])

    parts = kept.mapInArrow(run, "cluster int, n long, sums array<string>, squares string")
    exact = "decimal(38,0)"
    total = parts.select("cluster", "n", "squares", F.posexplode("sums").alias("axis", "x")).groupBy("cluster", "axis").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast(exact)).cast(exact).alias("x"), F.sum(F.col("squares").cast(exact)).cast(exact).alias("squares"))
    return total.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("axis", "x"))).alias("sums"), F.max("squares").alias("squares"))


def moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    """The floor of the mean of each cluster's vectors; a centroid without vectors stays."""
    out = list(centroids)
    for row in sums:
        out[row["cluster"]] = [int(s["x"]) // row["n"] for s in row["sums"]]
    return out


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, salt: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that takes part, distance squared; the final centroids)."""
    kept = kept_vectors(embeddings, dimension)
    centroids = first_centroids(kept, k, salt, scale)
    context = embeddings.sparkSession.sparkContext
    for _ in range(rounds if centroids else 0):
        tree = context.broadcast(Tree(centroids))
        centroids = moved(centroids, _sums(kept, tree, scale, len(centroids)).collect())
        tree.unpersist()
    tree = context.broadcast(Tree(centroids))

    def run(batches):
        for ids, _, number, square in _assigned(batches, tree, scale):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array([int(x) for x in square], pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def clusters_with_inertia(embeddings: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, salt: int = 1) -> DataFrame:
    """``cluster_vectors`` with the summed distance of the cluster and of all vectors, and a digest of the final centroid."""
    found, centroids = cluster_vectors(embeddings, k, rounds, dimension, scale, salt)
    tree = embeddings.sparkSession.sparkContext.broadcast(Tree(centroids))
    totals = {r["cluster"]: int(r["squares"]) for r in _sums(kept_vectors(embeddings, dimension), tree, scale, len(centroids)).select("cluster", "squares").collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, totals[c], sum(totals.values()), digest[c]) for c in sorted(totals)]
    clusters = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle(k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, salt: int = 1) -> str:
    """The same in SQL: all distances in each round."""
    sql = f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension}),
 c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS INTEGER) AS c, v AS w FROM kept ORDER BY sha256('{salt}:' || vec_id), v LIMIT {k})"""
    for r in range(rounds + 1):
        sql += f""",
 p{r} AS (SELECT row_number() OVER () AS id, vec_id, v FROM kept),
 a{r} AS (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM (SELECT id, vec_id, v, c, list_sum(list_transform(range(1, {dimension + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d FROM p{r}, c{r}) GROUP BY id)"""
        if r < rounds:
            sql += f""",
 s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(range(1, {dimension + 1})) AS i, unnest(v) AS x FROM a{r}) GROUP BY ALL),
 n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS w FROM s{r} GROUP BY c),
 c{r + 1} AS (SELECT o.c, coalesce(n.w, o.w) AS w FROM c{r} o LEFT JOIN n{r} n ON n.c = o.c)"""
    return sql + f"""
SELECT vec_id, c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM (SELECT vec_id, m, m.c AS c FROM a{rounds}) JOIN c{rounds} USING (c)"""


ORACLE = _oracle()
