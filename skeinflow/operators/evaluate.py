"""Evaluation of scored rows (y_true, y_pred, y_prob, grp) in aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.stages import settle


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def _outcomes() -> list[Column]:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return [t & p, ~t & p, ~t & ~p, t & ~p]


def tallies() -> list[Column]:
    return [_count(c).alias(n) for n, c in zip(("tp", "fp", "tn", "fn"), _outcomes())]


def rates(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, tn, fn) with accuracy, precision, recall and F1; 0 where a denominator is."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumn("accuracy", _ratio(tp + tn, tp + fp + tn + fn)).withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn)).withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def classification_metrics(rows: DataFrame) -> DataFrame:
    return rates(rows.agg(*tallies()))


TALLY = ("tp", "fp", "tn", "fn")
#: Groups in a range, about: what one task draws among at a time.
RANGE_GROUPS = 4096


def _split_draws(sizes: np.ndarray, seed: int):
    """For each resample (b): how many of its draws fall into each range, by conditional binomials."""
    total, share = int(sizes.sum()), sizes / max(sizes.sum(), 1)

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                m = np.random.default_rng((seed, 0, b)).multinomial(total, share)
                r = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), b)), pa.array(r.astype(np.int32)), pa.array(m[r])], ["b", "r", "m"])

    return run


def _draw(seed: int):
    """Within a range: how often each of its groups is drawn in each resample, times its tallies."""

    def run(key: tuple, groups: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        tallies = groups.sort_values(["h", *TALLY])[[*TALLY]].to_numpy()
        even = np.full(len(tallies), 1 / max(len(tallies), 1))
        sums = [np.random.default_rng((seed, 1 + key[0], b)).multinomial(m, even) @ tallies for b, m in zip(draws["b"].tolist(), draws["m"].tolist())]
        return pd.DataFrame(np.column_stack([draws["b"], np.array(sums).reshape(-1, 4)]), columns=["b", *TALLY])

    return run


def bootstrap_tallies(rows: DataFrame, group: str | None, draws: int = 1000, seed: int = 42, range_groups: int = RANGE_GROUPS) -> DataFrame:
    """(b, tp, fp, tn, fn): the tallies of ``draws`` resamples with replacement of whole groups, or of rows without ``group``.

    Groups become tallies first. Those of one range of their hash stay together, ``range_groups`` on average; a resample's
    draws are split among ranges by conditional binomials and then within each range, which is the same distribution. So no
    task sees more than a range, nothing numbers all groups, and one long for each range comes to the driver."""
    spark = rows.sparkSession
    grid = spark.range(draws).select(F.col("id").alias("b"))
    if group is None:
        # at most four kinds of rows: their numbers in a resample are one draw
        kinds = rows.select(*[c.alias(n) for n, c in zip(TALLY, _outcomes())]).groupBy(*TALLY).count().orderBy(*TALLY).collect()
        weights = np.array([k["count"] for k in kinds], float)
        one = np.array([[int(k[t]) for t in TALLY] for k in kinds]).reshape(-1, 4)

        def run(batches):
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    m = np.random.default_rng((seed, 0, b)).multinomial(int(weights.sum()), weights / weights.sum()) @ one if len(weights) else np.zeros(4, int)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (b, *m.tolist())], ["b", *TALLY])

        return grid.mapInArrow(run, "b long, tp long, fp long, tn long, fn long")
    base = settle(rows.groupBy(group).agg(*tallies()).select(F.xxhash64(group).alias("h"), *TALLY), "bootstrap-groups")
    ranges = max(1, -(-base.count() // range_groups))
    base = base.withColumn("r", F.pmod("h", F.lit(ranges)).cast("int"))
    sizes = np.zeros(ranges, np.int64)
    for r in base.groupBy("r").count().collect():
        sizes[r["r"]] = r["count"]
    split = grid.mapInArrow(_split_draws(sizes, seed), "b long, r int, m long")
    summed = base.groupBy("r").cogroup(split.groupBy("r")).applyInPandas(_draw(seed), "b long, tp long, fp long, tn long, fn long")
    return summed.groupBy("b").agg(*[F.sum(c).alias(c) for c in TALLY])


def bootstrap_ci(rows: DataFrame, group: str | None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, value, low, high): 2.5 and 97.5 percentiles over resamples of whole groups, or of rows without ``group``."""
    resampled = bootstrap_tallies(rows, group, draws, seed)
    metrics = ("precision", "recall", "f1")
    unpivot = lambda df, v: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(v)) for m in metrics])).alias("r")).select("r.*")
    found = unpivot(rates(resampled), "x").groupBy("metric").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return unpivot(classification_metrics(rows), "value").join(found, "metric").select("metric", "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def calibration_curve(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, positive_rate) of equal bins of y_prob, the last one closed; empty ones have their middle and 0."""
    own = F.least(F.floor(F.col("y_prob") * bins).cast("int"), F.lit(bins - 1))
    by = rows.where(F.col("y_prob").between(0, 1)).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg("y_prob").alias("c"), F.avg(F.col("y_true").cast("double")).alias("r"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(by, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("c", (F.col("bin") + 0.5) / bins).alias("confidence"), F.coalesce("r", F.lit(0.0)).alias("positive_rate"))


def brier_ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: mean squared error of y_prob, and the bins' mean distance of rate and confidence, weighted by n."""
    brier = rows.agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), 2)).alias("brier"))
    curve = calibration_curve(rows, bins)
    ece = curve.agg((F.sum(F.col("n") * F.abs(F.col("positive_rate") - F.col("confidence"))) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))
    return brier.crossJoin(ece)


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve; 1 with one class alone.

    Rows are summed by score first; the running number of rows below a score is over distinct scores, in two steps: within
    ranges of scores and between them."""
    by = rows.groupBy("y_prob").agg(F.count("*").alias("n"), F.sum((F.col("y_true") == 1).cast("long")).alias("pos")).withColumn("range", F.floor(F.col("y_prob") * 4096))
    ranges = by.groupBy("range").agg(F.sum("n").alias("rn"))
    ranges = ranges.select("range", (F.sum("rn").over(Window.orderBy("range")) - F.col("rn")).alias("base"))
    own = F.sum("n").over(Window.partitionBy("range").orderBy("y_prob"))
    placed = by.join(ranges, "range").withColumn("rank", F.col("base") + own - (F.col("n") - 1) / 2)
    sums = placed.agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("t"))
    one = (F.col("p") == 0) | (F.col("p") == F.col("t"))
    return sums.select(F.when(one, 1.0).otherwise((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.when(one, 1.0).otherwise(F.col("p") * (F.col("t") - F.col("p")))).alias("auc"))


def latency_percentiles(rows: DataFrame, column: str, keys: list[str], approximate: bool = False, accuracy: int = 100_000) -> DataFrame:
    """Mean, p50, p95, p99 and maximum by ``keys``; percentiles are the values at place floor(n p) + 1, or approximate. Nulls
    are no values.

    The exact ones are selected, not sorted out: a sketch brackets each place, the values below a bracket are counted, and
    only the distinct values inside it are put in order, 4 / ``accuracy`` of a key's rows. Keys with no more rows than
    ``accuracy`` are one bracket."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    value = F.col(column)
    if approximate:
        return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), *[F.percentile_approx(value, p, 10_000).alias(n) for n, p in points.items()], F.max(value).alias("max"))
    near = [max(0.0, min(1.0, p + d / accuracy)) for p in points.values() for d in (-2, 2)]
    sketch = F.percentile_approx(value, F.array(*map(F.lit, near)), accuracy)
    stats = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.min(value).alias("_least"), F.max(value).alias("max"), sketch.alias("_q"))
    small = F.col("_n") <= accuracy
    place = lambda p: F.least(F.floor(F.col("_n") * p).cast("long") + 1, F.col("_n"))
    bracket = lambda i, n, p: F.struct(F.lit(n).alias("point"), place(p).alias("place"), F.when(small, F.col("_least")).otherwise(F.col("_q")[2 * i]).alias("low"), F.when(small, F.col("max")).otherwise(F.col("_q")[2 * i + 1]).alias("high"))
    stats = settle(stats.select(*keys, "mean", "max", F.array(*[bracket(i, n, p) for i, (n, p) in enumerate(points.items())]).alias("_b")), "brackets")
    known = stats.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    met = rows.where(value.isNotNull()).select(*keys, value.alias("_v")).join(known, same).select(*keys, "_v", F.explode("_b").alias("b")).where("_v <= b.high")
    counts = met.groupBy(*keys, "b", F.when(F.col("_v") >= F.col("b.low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))  # null: all below
    upto = F.sum("c").over(Window.partitionBy(*keys, "b").orderBy(F.asc_nulls_first("_v")))
    reached = counts.withColumn("_upto", upto).where("_upto >= b.place and _v is not null")
    found = reached.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*[F.min(F.when(F.col("b.point") == n, F.col("_v"))).alias(n) for n in points])
    return stats.join(found, same, "left").select(*keys, "mean", *points, "max")
