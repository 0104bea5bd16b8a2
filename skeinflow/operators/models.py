"""Training, calibration and scoring of detector models with pyspark.ml, on whole groups."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from . import evaluate as V
from ..plans.stages import settle

#: Parts of names that identify rows; names with one of the summaries are features all the same.
IDENTIFIERS = ("ip", "port", "flow_id", "seed", "timestamp", "mac", "ts_us")
SUMMARIES = ("count", "entropy", "ratio", "distinct", "unique", "mean", "std", "cv")
#: Labels are 0 and 1; without this a forest has as many classes as its largest label tells, one if no training row is a 1.
TWO_CLASSES = {"ml_attr": {"type": "binary"}}


def select_features(df: DataFrame, columns: list[str], strict: bool = False) -> list[str]:
    """The names that are no identifiers; with ``strict`` an identifier is an error."""

    def identifies(name: str) -> bool:
        parts = f"_{name.lower()}_"
        return any(f"_{i}_" in parts for i in IDENTIFIERS) and not any(f"_{s}_" in parts for s in SUMMARIES)

    bad = [c for c in columns if identifies(c)]
    if bad and strict:
        raise ValueError(f"identifiers among the features: {bad}")
    return [c for c in columns if c in df.columns and c not in bad]


def augment_rows(df: DataFrame, features: list[str], min_rows: int, seed: int = 42) -> DataFrame:
    """``df`` with copies until there are ``min_rows``, their features moved by normal noise of 0.01; ``copy`` is 0 for rows
    of the input.

    The noise is drawn by a hash of the row's values, the copy and the feature, so a task that runs again, or other
    partitions, give the same rows; rows that are equal have equal copies."""
    n = df.count()
    times = max(1, -(-min_rows // max(n, 1)))
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    uniform = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.lit(k), "_row", "copy"), F.lit(1 << 52)) + 0.5) / (1 << 52)
    normal = lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1))
    noise = lambda i: F.when(F.col("copy") == 0, 0.0).otherwise(normal(i) * 0.01)
    return rows.withColumns({c: F.col(c) + noise(i) for i, c in enumerate(features)}).drop("_row")


def group_split(df: DataFrame, group: str, shares=(0.6, 0.2, 0.2), seed: int = 42) -> DataFrame:
    """(group, split): whole groups to train, val and test, at least one each, in order of a seeded hash: places within the
    ranges of the hash's first digits, and the ranges' sums."""
    names = df.select(F.col(group).alias("grp")).distinct()
    n = names.count()
    if n < 3:
        raise ValueError("a split needs three groups")
    train = min(max(1, round(n * shares[0])), n - 2)
    val = min(max(1, round(n * shares[1])), n - train - 1)
    hashed = names.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("grp").cast("string"), F.lit("")))))
    hashed = hashed.withColumn("_range", F.substring("_h", 1, 3))
    sums = hashed.groupBy("_range").agg(F.count("*").alias("_c"))  # 4096 rows at most
    sums = sums.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", "grp"))
    split = F.when(F.col("r") <= train, "train").when(F.col("r") <= train + val, "val").otherwise("test")
    return hashed.join(F.broadcast(sums), "_range").withColumn("r", place).select("grp", split.alias("split"))


def leakage_probe(df: DataFrame, features: list[str], scenario: str, limit: float = 0.90, check: bool = True) -> DataFrame:
    """One row: the accuracy of a tree of depth 3 that guesses the scenario from the features, over three folds. Above the
    limit the features give the scenario away, which is an error with ``check``."""
    tree = DecisionTreeClassifier(labelCol="_y", featuresCol="_x", maxDepth=3, seed=42)
    pipeline = Pipeline(stages=[StringIndexer(inputCol=scenario, outputCol="_y"), VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), tree])
    folds = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy"), numFolds=3, seed=42)
    accuracy = float(folds.fit(df).avgMetrics[0])
    if check and accuracy > limit:
        raise ValueError(f"features give the scenario away: accuracy {accuracy:.3f}")
    return df.sparkSession.range(1).select(F.lit(accuracy).alias("accuracy"), F.lit(accuracy > limit).alias("leaks"))


def train_detector(rows: DataFrame, features: list[str], label: str = "y_true", split: str = "split") -> tuple[PipelineModel, IsotonicRegressionModel]:
    """A forest of 40 trees of depth 6 on the training rows, calibrated by isotonic regression on the validation rows. A split
    may hold one label alone: trees that saw no 1 give it a probability of 0."""
    rows = rows.withMetadata(label, TWO_CLASSES)
    forest = RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=40, maxDepth=6, seed=42)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), forest]).fit(rows.where(F.col(split) == "train"))
    val = model.transform(rows.where(F.col(split) == "val")).withColumn("_raw", vector_to_array("probability")[1])
    return model, IsotonicRegression(labelCol=label, featuresCol="_raw", predictionCol="y_prob").fit(val.drop("prediction").withColumn(label, F.col(label).cast("double")))


def score_detector(rows: DataFrame, model: PipelineModel, calibration: IsotonicRegressionModel) -> DataFrame:
    """``rows`` with y_prob, calibrated, and y_pred at 0.5."""
    scored = model.transform(rows).withColumn("_raw", vector_to_array("probability")[1])
    scored = calibration.transform(scored.drop("prediction"))
    return scored.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")).select(*rows.columns, "y_prob", "y_pred")


def evaluate_detector(scored: DataFrame, draws: int = 200) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1 with its interval, AUC, Brier score and calibration error."""
    scored = settle(scored, "scored")
    f1 = V.bootstrap_ci(scored, "grp", draws).where("metric = 'f1'").select(F.col("low").alias("f1_low"), F.col("high").alias("f1_high"))
    return V.classification_metrics(scored).crossJoin(f1).crossJoin(V.roc_auc(scored)).crossJoin(V.brier_ece(scored))
