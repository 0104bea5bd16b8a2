import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinflow.llm import ann, queries, simhash, vector_dedup
from skeinflow.llm.components import connected_components

from .conftest import SF


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(ids, linked):
    """Smallest member of each group, by union-find over all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups_of(sorted(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_of_a_dense_group(spark):
    random = np.random.default_rng(5)
    center = int(random.integers(0, 1 << 63))
    prints = {center} | {center ^ sum(1 << int(b) for b in random.choice(64, random.integers(1, 7), False)) for _ in range(150)} | {int(x) for x in random.integers(0, 1 << 63, 100)}
    prints = sorted(prints)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(prints)], "fp long, id long")
    edges = simhash.link_edges(table)
    assert all((prints[r["a"]] ^ prints[r["b"]]).bit_count() <= 4 for r in edges.collect())
    got = {i: i for i in range(len(prints))} | {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == groups_of(range(len(prints)), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)


def test_rows_without_an_id_connect(spark, monkeypatch):
    texts = {"a": 0xF0, "b": 0xF0 ^ 7, "c": 0xF0 ^ 63, "d": (1 << 63) | 0xFF00FF00}
    prints = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    named = spark.createDataFrame([(k, v if v < 1 << 63 else v - (1 << 64)) for k, v in texts.items()], "text string, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.join(named, "text").select("doc_id", "fp"))
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(prints).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (None, None)}


def test_simhash_odd(odd, empty):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 7)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 7)} == {3}
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 3, 5, 6, 8]
    assert simhash.simhash_groups(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("a > 1000")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, vector string, n string"


def odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.01]), (7, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 0.0]), (50, [1.0, 0.0]), (100, [-0.0, 1.0])]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            best = {}
            for i, y in good:
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -2), float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)))
            out[q] = sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


def test_nearest_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, 5)
    got = queries.op5_ann(spark, sf).collect()
    scores = {(q, i): s for q, near in brute_nearest(rows, len(rows)).items() for i, s in near}
    for r in got:
        assert r["score"] == pytest.approx(scores[r["query_id"], r["vec_id"]], abs=1e-12)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    truth = {(q, i) for q, near in want.items() for i, _ in near}
    assert len(found & truth) / len(truth) >= 0.9
    assert len(got) == 5 * len(want)


def test_nearest_odd(spark):
    table = odd_vectors(spark)
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()], 5)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items() if n}
    assert ann.nearest(table.limit(0), F.lit(True), 5).count() == 0


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    random = np.random.default_rng(2)
    rows = [(i, (np.array([1.0, 0, 0, 0]) + random.normal(0, 0.05, 4)).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 10 == 0, 5, tables=2, probes=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 200, 10):
        s = x @ x[q]
        s[q] = -2
        assert got[q] == np.argsort(-s, kind="stable")[:5].tolist()


def test_ties_stay_within_k(spark):
    random = np.random.default_rng(4)
    for _ in range(50):
        score = random.integers(0, 4, (7, 12)).astype(float)
        score[random.random(score.shape) < 0.2] = -np.inf
        q, c = ann.best(score, 3)
        want = [(i, j) for i, row in enumerate(score) for j in sorted(np.argsort(-row, kind="stable")[:3]) if row[j] > -np.inf]
        assert sorted(zip(q.tolist(), c.tolist())) == want
    rows = spark.createDataFrame([(i % 300, [1.0, 2.0, 3.0, 4.0]) for i in range(1500)], "vec_id long, embedding array<double>")
    vectors = ann.numbered(rows)
    at = lambda df, p: df.mapInArrow(lambda b: ann._assign(b, 2, p), "tbl int, bucket long, vec_id long, vector array<double>")
    assert ann._search(at(vectors, 1), at(vectors.where("vec_id < 100").dropDuplicates(["vec_id"]), 1), 5).count() == 2 * 100 * 5
    got = ann.nearest(rows, F.col("vec_id") == 7, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def brute_groups(rows, threshold=0.9):
    units = [None if v is None or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v, float) / np.linalg.norm(v) for _, v in rows]
    near = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold
    n = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    roots = groups_of(range(len(rows)), near)
    least = {}
    for i, r in roots.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))


def test_vector_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    random = np.random.default_rng(3)
    centers = random.normal(size=(6, 16))
    rows = [(i, (centers[i % 6] + random.normal(0, 0.12 if i < 180 else 2.0, 16)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    got = vector_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_vector_groups_recall(spark):
    """Pairs just over the threshold, the hardest to find, among 20,000 vectors."""
    random = np.random.default_rng(5)
    x = random.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = random.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = random.uniform(0.901, 0.92, (10_000, 1))
    rows = pd.DataFrame({"vec_id": np.arange(20_000), "embedding": [v.tolist() for v in (*x, *(cosine * x + np.sqrt(1 - cosine**2) * other))]})
    got = vector_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got.n_links.sum() / 20_000 >= 0.99 and got.n_links.max() == 1


def test_vector_groups_odd(spark):
    table = odd_vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert sorted(map(tuple, vector_dedup.vector_groups(table).collect())) == brute_groups(rows)
    assert vector_dedup.vector_groups(table.limit(0)).count() == 0
