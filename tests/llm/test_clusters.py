import hashlib
import math

import numpy as np
import pytest

from skeinflow.llm import clusters as C, queries

from ..comparing import assert_equal, database
from .conftest import SF

KIND = "vec_id long, embedding array<double>, cluster string, distance string, vector string, n string, order string"


def brute(rows, k=16, rounds=3, dimension=64):
    """Everything against everything, with Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=order)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), i in zip(kept, of) if i == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *near(v)) for i, v in kept]
    sums = {c: sum(d for _, d, e in out if e == c) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for i, d, c in out), key=str)


def got(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in frame.collect()), key=str)


def test_equals_brute_force_and_sql(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op11_clusters(spark, SF)
    assert got(found) == brute(rows)
    assert_equal(found.toPandas(), database(SF).execute(C.ORACLE).df())


def test_odd_vectors(spark):
    """Nulls, other dimensions, non-finite components, zeros, ties, repeated rows and ids, clashing names, huge components."""
    rng = np.random.default_rng(5)
    grid = [[float(x) for x in v] for v in rng.integers(-1, 2, (60, 3))]
    rows = [(i, v) for i, v in enumerate(grid)] + [(3, grid[3]), (3, grid[4]), (None, grid[5]), (None, [0.5, 0.5, 0.5]), (90, None), (91, [1.0]), (92, [1.0, None, 0.0]), (93, [float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0]), (95, [0.0] * 3), (96, [1e7, -3e6, 0.01])]
    frame = spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], KIND)
    for k in (1, 5, 16, 200):
        assert got(C.clusters_with_inertia(frame, k=k, dimension=3)) == brute(rows, k, dimension=3)
    assert C.clusters_with_inertia(spark.createDataFrame([], KIND), dimension=3).collect() == []
    with pytest.raises(Exception):  # squared distances over a long
        C.clusters_with_inertia(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>"), k=1, dimension=1).collect()


@pytest.mark.parametrize("k", [1, 4, 5, 16, 300])
@pytest.mark.parametrize("spread", [1, 3, 1000, 2**30])
def test_tree_equals_scan(k, spread):
    rng = np.random.default_rng(k + spread)
    centroids, vectors = rng.integers(-spread, spread + 1, (k, 6)), rng.integers(-spread, spread + 1, (400, 6))
    number, square = C.Tree(centroids.tolist()).nearest(vectors.astype(float) if spread < C.EXACT else vectors.astype(object))
    exact = ((vectors[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
    assert number.tolist() == [min(range(k), key=lambda c: (row[c], c)) for row in exact]
    assert [int(x) for x in square] == [min(row) for row in exact]


def test_tree_prunes_clustered_centroids():
    """With centroids far apart most nodes are never reached."""
    rng = np.random.default_rng(1)
    centroids = np.cumsum(np.full((256, 2), 1000), 0)
    tree, seen = C.Tree(centroids.tolist()), []
    squares = tree._squares
    tree._squares = lambda rows, own: seen.append(len(rows) * len(own)) or squares(rows, own)
    vectors = centroids[rng.integers(0, 256, 500)] + rng.integers(-9, 10, (500, 2))
    tree.nearest(vectors.astype(float))
    assert sum(seen) < 500 * 256 / 8


def test_one_cluster_holds_most(spark):
    """Each task returns one row for a centroid, however many of its vectors it has."""
    rows = [(i, [1.0, 0.0] if i % 10 else [0.0, float(i % 7)]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    kept = C.kept_vectors(frame, 2)
    tree = spark.sparkContext.broadcast(C.Tree([[64, 0], [0, 64]]))
    parts = C._sums(kept, tree, 64, 2).collect()
    want = {0: [], 1: []}
    for _, v in rows:
        v = [math.floor(64 * x) for x in v]
        want[min((0, 1), key=lambda c: (v[c] - 64) ** 2 + v[1 - c] ** 2)].append(v)
    assert {r["cluster"]: (r["n"], [int(s["x"]) for s in r["sums"]]) for r in parts} == {c: (len(v), [sum(x) for x in zip(*v)]) for c, v in want.items()}
    assert len(want[0]) >= 1800
