from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import subnet_group
from ..operators import graph as G, models as M, windows as W
from ..plans.flow_view import DAY_US, duck, flow_view
from ..plans.stages import settle
from . import windows as WC
from .registry import query, rounded, table

FEATURES = ["n", "pps", "syn", "ack", "src_entropy", "udp_bytes_in"]


def training_rows(spark, sf_dir):
    """Destination windows with a label, a group and a split. The label is what the windows' features do not hold: whether at
    least a third of its events are errors; SYNs and sources hint at that."""
    flows = flow_view(spark, sf_dir)
    rows = W.dst_window_features(flows, DAY_US, reverse_bytes=False)
    kinds = flows.join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    told = kinds.groupBy(W.window_start(DAY_US), "dst_ip").agg((3 * F.count_if(F.col("event_type") == "error") >= F.count("*")).cast("int").alias("y_true"))
    rows = rows.join(told, ["window_us", "dst_ip"]).withColumn("grp", F.col("dst_ip"))
    return settle(rows.join(M.group_split(rows, "grp"), "grp").withColumns({c: F.col(c).cast("double") for c in FEATURES}), "training")


KEPT = ["n", "pps", "src_entropy", "syn_ack_ratio"]


@query(duck(WC.DST + " SELECT feature, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS largest FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM dst" for c in KEPT) + ") GROUP BY feature"))
def select_features(spark, sf_dir):
    """The features of a table that are no identifiers, and what their columns hold."""
    rows = W.dst_window_features(flow_view(spark, sf_dir), DAY_US).withColumn("window_ts_us", F.col("window_us")).withColumn("dst_port", F.lit(443))
    names = M.select_features(rows, ["dst_ip", "window_ts_us", "dst_port", "absent_ratio", *KEPT])
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names]))
    found = rows.select(values.alias("v")).groupBy(F.col("v.feature").alias("feature"))
    return rounded(found.agg(F.count("v.value").alias("n"), F.avg("v.value").alias("mean"), F.max("v.value").alias("largest")))


@query()
def augment_rows(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    out = M.augment_rows(rows, FEATURES, 2 * rows.count())
    return rounded(out.groupBy("copy", "grp").agg(F.count("*").alias("n"), F.avg("pps").alias("pps")))


@query("""WITH r AS (SELECT event_id, user_id AS a, CASE WHEN event_id % 50 = 0 THEN user_id % 10 END AS b FROM events),
 x AS (SELECT a AS u, coalesce(min(b), -1 - a) AS v FROM r GROUP BY a), m AS (SELECT a, b FROM r WHERE b IS NOT NULL GROUP BY ALL),
 k AS (SELECT r.event_id, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.a = r.a) THEN r.a % 10 ELSE 100000 + r.a END AS c FROM r)
 SELECT event_id, min(event_id) OVER (PARTITION BY c) AS "group" FROM k""")
def connected_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("a"), F.when(F.col("event_id") % 50 == 0, F.col("user_id") % 10).alias("b"))
    return G.connected_groups(rows, "event_id", ["a", "b"])


@query(duck(""", g AS (SELECT DISTINCT dst_ip AS grp FROM fv), o AS (SELECT grp, row_number() OVER (ORDER BY md5('42|' || grp)) AS r, count(*) OVER () AS n FROM g)
 SELECT grp, CASE WHEN r <= round(n * 0.6) THEN 'train' WHEN r <= round(n * 0.6) + round(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM o"""))
def group_split(spark, sf_dir):
    return M.group_split(flow_view(spark, sf_dir), "dst_ip")


@query()
def leakage_probe(spark, sf_dir):
    rows = training_rows(spark, sf_dir).withColumn("net", subnet_group(F.col("dst_ip")))
    return rounded(M.leakage_probe(rows, FEATURES, "net", check=False))


def _scored(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    return M.score_detector(rows.where("split = 'test'"), *M.train_detector(rows, FEATURES))


@query()
def train_detector(spark, sf_dir):
    model, calibration = M.train_detector(training_rows(spark, sf_dir), FEATURES)
    weights = model.stages[-1].featureImportances
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(weights[i])).alias("importance")) for i, f in enumerate(FEATURES)]))
    return rounded(spark.range(1).select(rows.alias("r")).select("r.*", F.lit(len(calibration.boundaries)).alias("calibration_steps")))


@query()
def score_detector(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("window_us", "dst_ip", "y_true", "y_prob", "y_pred"))


@query()
def evaluate_detector(spark, sf_dir):
    return rounded(M.evaluate_detector(_scored(spark, sf_dir)))
