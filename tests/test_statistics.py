"""Percentiles, resamples, spectra, components and splits against plain computations, and how much one task sees."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.catalog import QUERIES
from skeinflow.catalog.models import FEATURES
from skeinflow.operators import evaluate as V, graph as G, models as M, periodicity as P
from skeinflow.plans.stages import shared_dir


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_percentiles_are_selected_exactly(spark, accuracy):
    """More rows than the accuracy, so that brackets do the work; ties, nulls, null keys, and keys of one value."""
    draw = random.Random(accuracy)
    rows = [("a", draw.gauss(0, 1)) for _ in range(3000)] + [("b", float(draw.randrange(4))) for _ in range(700)] + [("c", 5.0)] + [("d", None)] * 3 + [(None, float(i)) for i in range(150)] + [("a", None)] * 9
    found = {r["k"]: r for r in V.latency_percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], accuracy=accuracy).collect()}
    assert set(found) == {"a", "b", "c", "d", None}
    for k in ("a", "b", "c", None):
        values = sorted(v for key, v in rows if key == k and v is not None)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert found[k][name] == values[min(int(len(values) * p), len(values) - 1)], (k, name)
        assert found[k]["max"] == values[-1] and found[k]["mean"] == pytest.approx(sum(values) / len(values))
    assert [found["d"][c] for c in ("mean", "p50", "p95", "p99", "max")] == [None] * 5


def test_percentiles_of_many_distinct_values(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 200_003).cast("double").alias("v"))
    [found] = V.latency_percentiles(rows, "v", ["k"], accuracy=1000).collect()
    assert found["p99"] == sorted((i * 7919) % 200_003 for i in range(200_000))[198_000]
    assert V.latency_percentiles(rows.where("v < 0"), "v", ["k"]).collect() == []


def test_bootstrap_has_the_moments_of_resampling(spark):
    """Means and variances of the resampled sums against the closed form, over many ranges of groups, and of rows."""
    draw = random.Random(2)
    rows = [(draw.randrange(2), draw.randrange(2), f"g{min(draw.randrange(700), draw.randrange(700))}") for _ in range(4000)]
    frame = spark.createDataFrame(rows, "y_true int, y_pred int, grp string")
    place = {(1, 1): 0, (0, 1): 1, (0, 0): 2, (1, 0): 3}
    units = np.eye(4)[[place[t, p] for t, p, _ in rows]]
    by_group = {}
    for unit, (_, _, g) in zip(units, rows):
        by_group[g] = by_group.get(g, 0) + unit
    groups = np.array([*by_group.values()])
    for group, values in (("grp", groups), (None, units)):
        got = V.bootstrap_tallies(frame, group, 1500, range_groups=32).toPandas()
        assert sorted(got["b"]) == [*range(1500)]
        sums = got[[*V.TALLY]].to_numpy(float)
        mean, variance = values.sum(0), len(values) * values.var(0)
        assert np.abs(sums.mean(0) - mean).max() < 5 * np.sqrt(variance.max() / 1500)
        assert np.allclose(sums.var(0), variance, rtol=0.2)
        if group is None:
            assert (sums.sum(1) == len(rows)).all()
    again = V.bootstrap_tallies(frame.repartition(7), "grp", 50, range_groups=32)
    assert sorted(again.collect()) == sorted(V.bootstrap_tallies(frame, "grp", 50, range_groups=32).collect())


def test_bootstrap_of_many_groups_is_many_tasks(spark):
    frame = spark.range(300_000).select((F.col("id") % 3 == 0).cast("int").alias("y_true"), (F.col("id") % 2 == 0).cast("int").alias("y_pred"), F.col("id").alias("grp"))
    found = V.bootstrap_ci(frame, "grp", 20).collect()
    assert all(r["low"] <= r["value"] + 0.01 and r["high"] >= r["value"] - 0.01 and r["high"] - r["low"] < 0.02 for r in found)


def plain_profile(times):
    """One pair at a time, with a transform of its own."""
    gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:]) if b - a > 50_000]
    mean = sum(gaps) / len(gaps) if gaps else 0.0
    span = times[-1] - times[0]
    if len(times) < 6 or span <= 10_000_000:
        steady = mean > 0 and np.std(gaps) < 0.1 * mean
        return (1 / mean if mean else 0.0), mean, 0.9 if steady else 0.5
    bins = min(span // 1_000_000 + 1, 1024)
    counts = np.zeros(bins)
    for t in times:
        counts[min((t - times[0]) * bins // span, bins - 1)] += 1
    size = np.array([abs(sum(c * np.exp(-2j * np.pi * (k * b % bins) / bins) for b, c in enumerate(counts) if c)) for k in range(bins // 2 + 1)])
    size[0] = 0
    size[size < 1e-9 * len(times)] = 0
    if not size.any():
        return 0.0, 0.0, 0.0
    peak = int(np.flatnonzero(size >= size.max() * (1 - 1e-9))[0])
    return peak / (span / 1e6), span / 1e6 / peak, size[peak] / size.sum()


def test_spectral_profiles(spark):
    draw = random.Random(4)
    pairs = {f"p{i}": sorted(draw.randrange(10 ** draw.randint(6, 9)) for _ in range(draw.choice([4, 5, 6, 20, 64]))) for i in range(40)}
    pairs["steady"] = [i * 20_000_000 for i in range(64)]
    pairs["one time"] = [5, 5, 5, 5, 5, 5, 5]
    pairs["even"] = [i * 1_000_000 for i in range(12)]
    pairs["two"] = [0, 0, 0, 50_000_000, 50_000_000, 50_000_000]
    rows = [(i, t, k, "d") for k, times in pairs.items() for i, t in enumerate(times)] + [(0, 1, "few", "d"), (1, 2, "few", "d")]
    found = {r["src_ip"]: r for r in P.spectral_profile(spark.createDataFrame(rows, "event_id long, ts_us long, src_ip string, dst_ip string")).collect()}
    assert set(found) == set(pairs)
    for k, times in pairs.items():
        got = found[k]
        assert got["contacts"] == len(times)
        assert (got["dominant_hz"], got["dominant_s"], got["spectral_power"]) == pytest.approx(plain_profile(times), abs=1e-9), k
    assert found["steady"]["dominant_s"] == pytest.approx(20.0, rel=0.02)


def tables(spark):
    return {d.split("-")[0] for d in os.listdir(shared_dir(spark).removeprefix("file:"))}, len(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_a_value_that_a_third_of_the_rows_have(spark):
    """Chains, pairs and a hot value; no round's table is left."""
    n = 6000
    rows = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.floor(F.col("id") / 2).cast("string"))).alias("a"), F.when(F.col("id") % 10 == 1, F.concat(F.lit("w"), F.floor(F.col("id") / 100).cast("string"))).alias("b"))
    values = rows.select("k", F.col("a").alias("v")).where("v = 'hot'")
    edges = G.shared_value_edges(values)
    assert edges.count() == n // 3 - 1
    assert edges.groupBy("b").count().agg(F.max("count")).first()[0] < n // 3 / 20  # no node has most of them
    _, before = tables(spark)
    found = {r["k"]: r["group"] for r in G.connected_groups(rows, "k", ["a", "b"]).collect()}
    assert tables(spark)[1] == before + 1
    parent = [*range(n)]

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for r in rows.collect():
        for v in (("a", r["a"]), ("b", r["b"])):
            if v[1] is not None:
                a, b = sorted((root(r["k"]), root(first.setdefault(v, r["k"]))))
                parent[b] = a
    assert found == {k: root(k) for k in range(n)}


def test_contraction_keeps_components(spark):
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 500, 400), draw.integers(0, 500, 400)
    nodes, roots = G._roots(a, b)
    assert (roots <= nodes).all()
    label = dict(zip(nodes.tolist(), roots.tolist()))
    assert all(label[x] == label[y] for x, y in zip(a.tolist(), b.tolist()))
    path = spark.range(999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert G.contract(path.coalesce(1)).select(F.max("b"), F.count("*")).first() == (0, 999)
    assert {r["component"] for r in G.propagate(path.repartition(4)).collect()} == {0}


def test_split_of_many_groups(spark):
    names = spark.range(20_000).select(F.col("id").cast("string").alias("g"))
    found = M.group_split(names, "g")
    order = found.select("split", F.md5(F.concat(F.lit("42|"), "grp")).alias("h")).toPandas().sort_values("h")["split"].tolist()
    assert order == ["train"] * 12_000 + ["val"] * 4000 + ["test"] * 4000


def test_augmented_rows_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") / 7).alias("x"), F.lit(1.0).alias("y"))
    one, other = (sorted(M.augment_rows(rows.repartition(n), ["x", "y"], 5000).collect()) for n in (1, 7))
    assert one == other and len(one) == 5000
    noise = np.array([r["y"] - 1.0 for r in one if r["copy"]])
    assert len(noise) == 4500 and abs(noise.mean()) < 0.001 and abs(noise.std() - 0.01) < 0.0005
    assert all(r["y"] == 1.0 and r["x"] == r["id"] / 7 for r in one if not r["copy"])
    moved = np.array([(r["x"] - r["id"] / 7, r["y"] - 1.0) for r in one if r["copy"]])
    assert abs(np.corrcoef(moved.T)[0, 1]) < 0.06


def training(spark, n=3000, seed=1):
    draw = np.random.default_rng(seed)
    y = draw.random(n) < 0.3
    a, b = draw.normal(y * 1.5, 1), draw.normal(0, 1, n)
    rows = [(int(t), float(p), float(q), f"g{i % 60}", ["train", "train", "train", "val", "test"][i % 60 % 5], f"s{i % 4}") for i, (t, p, q) in enumerate(zip(y, a, b))]
    return spark.createDataFrame(rows, "y_true int, a double, b double, grp string, split string, scenario string")


def test_leaks_are_found(spark):
    rows = training(spark)
    fair = M.leakage_probe(rows, ["a", "b"], "scenario").first()
    assert fair["accuracy"] < 0.4 and not fair["leaks"]
    leaky = rows.withColumn("a", F.substring("scenario", 2, 1).cast("double"))
    with pytest.raises(ValueError):
        M.leakage_probe(leaky, ["a", "b"], "scenario")
    assert M.leakage_probe(leaky, ["a", "b"], "scenario", check=False).first()["accuracy"] > 0.99


def test_detector_learns_and_is_calibrated(spark):
    rows = training(spark)
    model, calibration = M.train_detector(rows, ["a", "b"])
    weights = model.stages[-1].featureImportances
    assert weights[0] > 3 * weights[1]
    scored = M.score_detector(rows.where("split = 'test'"), model, calibration)
    got = scored.toPandas()
    assert len(got) == 600 and ((got.y_prob >= 0) & (got.y_prob <= 1)).all() and ((got.y_prob >= 0.5) == (got.y_pred == 1)).all()
    assert got.y_prob[got.y_true == 1].mean() > got.y_prob[got.y_true == 0].mean() + 0.2
    assert (got.y_pred == got.y_true).mean() > 0.75
    again = M.score_detector(rows.where("split = 'test'").repartition(5), *M.train_detector(rows, ["a", "b"]))
    assert sorted(again.select("a", "y_prob").collect()) == sorted(scored.select("a", "y_prob").collect())
    found = M.evaluate_detector(scored).first()
    t, p = got.y_true == 1, got.y_pred == 1
    tp, fp, fn = (t & p).sum(), (~t & p).sum(), (t & ~p).sum()
    assert (found["tp"], found["fp"], found["fn"]) == (tp, fp, fn)
    assert found["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and found["f1_low"] <= found["f1"] <= found["f1_high"]
    assert found["brier"] == pytest.approx(((got.y_prob - got.y_true) ** 2).mean())
    pos, neg = got.y_prob[t].to_numpy(), got.y_prob[~t].to_numpy()
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert found["auc"] == pytest.approx(auc) and auc > 0.8 and math.isfinite(found["ece"])


@pytest.fixture(scope="module")
def calm(spark, tmp_path_factory):
    """A folder with the smallest events, none of them an error, so that no destination's window has the label."""
    at = str(tmp_path_factory.mktemp("calm"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("event_type", F.regexp_replace("event_type", "^error$", "click")).write.parquet(f"{at}/events.parquet")
    return at


def test_a_detector_is_evaluated_without_positive_windows(spark, calm):
    found = QUERIES["evaluate_detector"](spark, calm).first()
    assert found["tn"] > 0 and (found["tp"], found["fp"], found["fn"]) == (0, 0, 0)
    assert (found["accuracy"], found["f1"], found["f1_low"], found["f1_high"], found["auc"], found["brier"], found["ece"]) == (1, 0, 0, 0, 1, 0, 0)


@pytest.mark.parametrize("known", [0, 1])
def test_a_detector_trained_on_one_label(spark, known):
    """Two classes whatever the rows hold, no feature that counts, and one step of calibration."""
    rows = training(spark, 600).withColumn("y_true", F.lit(known))
    model, calibration = M.train_detector(rows, ["a", "b"])
    forest = model.stages[-1]
    assert forest.numClasses == 2 and forest.getNumTrees == 40 and not forest.featureImportances.toArray().any()
    assert {tuple(r["probability"]) for r in model.transform(rows).select("probability").collect()} == {(1.0 - known, float(known))}
    assert list(calibration.boundaries) == [known] and list(calibration.predictions) == [known]


def test_importances_without_positive_windows(spark, calm):
    found = QUERIES["train_detector"](spark, calm).collect()
    assert sorted(r["feature"] for r in found) == sorted(FEATURES) and {(r["importance"], r["calibration_steps"]) for r in found} == {(0.0, 1)}


@pytest.mark.parametrize("known", [0, 1])
def test_scores_of_a_detector_that_saw_one_label(spark, known):
    """Trees that saw one label tell no rows apart, so the calibrated score is the validation's share of 1s, also in other splits."""
    rows = training(spark, 600).withColumn("y_true", F.when(F.col("split") == "train", known).otherwise(F.col("y_true")))
    share = rows.where("split = 'val'").agg(F.avg("y_true")).first()[0]
    scored = M.score_detector(rows.where("split = 'test'"), *M.train_detector(rows, ["a", "b"]))
    assert scored.columns == [*rows.columns, "y_prob", "y_pred"]
    got = scored.toPandas()
    assert len(got) == 120 and set(got.y_true) == {0, 1} and 0 < share < 0.5
    assert got.y_prob.to_numpy() == pytest.approx(share) and (got.y_pred == 0).all()


def test_scores_without_positive_windows(spark, calm):
    scored = QUERIES["score_detector"](spark, calm).toPandas()
    assert len(scored) > 0 and not scored.duplicated(["window_us", "dst_ip"]).any()
    assert (scored.y_true == 0).all() and (scored.y_prob == 0).all() and (scored.y_pred == 0).all()


def test_identifiers_are_no_features(spark):
    rows = spark.createDataFrame([(1,) * 8], "src_ip int, dst_port int, window_ts_us int, flow_id int, n int, port_entropy int, distinct_ip_count int, tip int")
    assert M.select_features(rows, [*rows.columns, "absent"]) == ["n", "port_entropy", "distinct_ip_count", "tip"]
    with pytest.raises(ValueError):
        M.select_features(rows, rows.columns, strict=True)
