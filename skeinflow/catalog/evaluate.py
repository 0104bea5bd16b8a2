from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A, evaluate as V, incidents as I, ledger as G
from ..plans.flow_view import DAY_US, duck, flow_view
from ..plans.stages import new_path, settle
from ..sources import flow_logs as SF
from . import alerts as CA
from .registry import query, rounded, table

Y = """WITH y AS (SELECT l.doc_id, l.toxic AS y_true, CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS y_raw, source AS grp FROM labels l JOIN documents d USING (doc_id)),
 v AS (SELECT doc_id, y_true, least(1.0, y_raw * 0.6 + y_true * 0.35) AS y_prob, CASE WHEN y_raw * 0.6 + y_true * 0.35 >= 0.5 THEN 1 ELSE 0 END AS y_pred, grp FROM y)"""


def scored(spark, sf_dir):
    """Labelled documents with a made-up score that knows a little: a stand-in for a detector's output."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp")), "doc_id")
    raw = (F.col("doc_id") * 37 % 101).cast("double") / 100
    prob = raw * 0.6 + F.col("toxic") * 0.35
    return rows.select("doc_id", F.col("toxic").alias("y_true"), F.least(F.lit(1.0), prob).alias("y_prob"), F.when(prob >= 0.5, 1).otherwise(0).alias("y_pred"), "grp")


@query(Y + """, c AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn FROM v)
 SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) + 0.0 AS f1 FROM c""")
def classification_metrics(spark, sf_dir):
    return rounded(V.classification_metrics(scored(spark, sf_dir)))


@query()
def bootstrap_ci(spark, sf_dir):
    return rounded(V.bootstrap_ci(scored(spark, sf_dir), "grp", 500))


CURVE = ", b AS (SELECT CAST(least(floor(y_prob * 10), 9) AS INT) AS bin, count(*) AS n, avg(y_prob) AS c, avg(y_true) AS r FROM v GROUP BY ALL), cv AS (SELECT CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n, coalesce(c, (g.bin + 0.5) / 10) AS confidence, coalesce(r, 0) AS positive_rate FROM range(10) g(bin) LEFT JOIN b ON b.bin = g.bin)"


@query(Y + CURVE + " SELECT bin, n, round(confidence, 6) + 0.0 AS confidence, round(positive_rate, 6) + 0.0 AS positive_rate FROM cv")
def calibration_curve(spark, sf_dir):
    return rounded(V.calibration_curve(scored(spark, sf_dir)))


@query(Y + CURVE + " SELECT round((SELECT avg(power(y_prob - y_true, 2)) FROM v), 6) + 0.0 AS brier, round(sum(n * abs(positive_rate - confidence)) / sum(n), 6) + 0.0 AS ece FROM cv")
def brier_ece(spark, sf_dir):
    return rounded(V.brier_ece(scored(spark, sf_dir)))


@query(Y + ", r AS (SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2 AS k FROM v), s AS (SELECT sum(k) FILTER (WHERE y_true = 1) AS s, count(*) FILTER (WHERE y_true = 1) AS p, count(*) AS t FROM r) SELECT round((s - p * (p + 1) / 2) / (p * (t - p)), 6) + 0.0 AS auc FROM s")
def roc_auc(spark, sf_dir):
    return rounded(V.roc_auc(scored(spark, sf_dir)))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type, round(avg(value), 6) + 0.0 AS mean, round(max(value) FILTER (WHERE r = least(floor(n * 0.5) + 1, n)), 6) + 0.0 AS p50, round(max(value) FILTER (WHERE r = least(floor(n * 0.95) + 1, n)), 6) + 0.0 AS p95, round(max(value) FILTER (WHERE r = least(floor(n * 0.99) + 1, n)), 6) + 0.0 AS p99, round(max(value), 6) + 0.0 AS max FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return rounded(V.latency_percentiles(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"]))


GAP_S = 86_400.0
CL = f""", ev AS (SELECT ts_us / 1e6 AS ts, dst_ip AS entity, protocol = 'UDP' AND event_id % 7 = 0 AS is_attack FROM fv), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts) <= {GAP_S} THEN 0 ELSE 1 END AS new FROM ev),
 n AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g), cl AS (SELECT entity, min(ts) AS first_ts, bool_or(is_attack) AS is_attack, count(*) AS alerts FROM n GROUP BY entity, i)"""


def alert_events(spark, sf_dir):
    return flow_view(spark, sf_dir).select((F.col("ts_us") / 1e6).alias("ts"), F.col("dst_ip").alias("entity"), ((F.col("protocol") == "UDP") & (F.col("event_id") % 7 == 0)).alias("is_attack"))


@query(duck(CL + " SELECT entity, round(first_ts, 6) + 0.0 AS first_ts, is_attack, alerts FROM cl"))
def incident_clusters(spark, sf_dir):
    return rounded(I.incident_clusters(alert_events(spark, sf_dir), GAP_S))


@query(duck(CL + " SELECT CAST(sum(alerts) AS BIGINT) AS alerts, count(*) AS incidents, count(*) FILTER (WHERE NOT is_attack) AS false_incidents, round(greatest(0, min(first_ts) FILTER (WHERE is_attack) - 1704067200), 6) + 0.0 AS seconds_to_detect, round(count(*) FILTER (WHERE NOT is_attack) / 720, 6) + 0.0 AS false_per_hour FROM cl"))
def incident_operations(spark, sf_dir):
    return rounded(I.incident_operations(alert_events(spark, sf_dir), 1_704_067_200.0, 720.0, GAP_S))


def _alerts(spark, sf_dir):
    return settle(CA.alert_table(spark, sf_dir).select("alert_id", "ts_us", "threat_class", "severity"), "alerts")


#: Leaves, and roots of blocks of ten by four folds.
LEDGER = CA.AL + """, lf AS (SELECT alert_id, ts_us, sha256('{"alert_id":"' || alert_id || '","severity":"' || severity || '","threat_class":"' || threat_class || '","ts_us":' || ts_us || '}') AS leaf, row_number() OVER (ORDER BY ts_us, alert_id) - 1 AS n FROM al),
 b0 AS (SELECT n // 10 AS h, n % 10 AS i, leaf AS x FROM lf)""" + "".join(
    f", b{k + 1} AS (SELECT a.h, a.i // 2 AS i, CASE WHEN (SELECT count(*) FROM b{k} c WHERE c.h = a.h) > 1 THEN sha256(unhex(a.x || coalesce(b.x, a.x))) ELSE a.x END AS x FROM b{k} a LEFT JOIN b{k} b ON b.h = a.h AND b.i = a.i + 1 WHERE a.i % 2 = 0)" for k in range(4)
)


@query(duck(LEDGER + " SELECT h AS block_height, x AS merkle_root FROM b4"))
def merkle_root(spark, sf_dir):
    return G.ledger_chain(_alerts(spark, sf_dir)).select("block_height", "merkle_root")


SEALED = "sha256(unhex({prev}) || unhex(blk.x) || encode(blk.t) || '\\x00'::BLOB || encode('{meta}'))"
CHAIN = f""", tm AS (SELECT n // 10 AS h, max(ts_us) AS us FROM lf GROUP BY ALL), blk AS (SELECT b4.h, x, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS t FROM b4 JOIN tm ON tm.h = b4.h),
 ch AS (SELECT h, '{G.GENESIS}' AS prev, x, t, {SEALED.format(prev=f"'{G.GENESIS}'", meta=G.METADATA)} AS own FROM blk WHERE h = 0 UNION ALL SELECT blk.h, ch.own, blk.x, blk.t, {SEALED.format(prev="ch.own", meta=G.METADATA)} FROM ch JOIN blk ON blk.h = ch.h + 1)
 SELECT h AS block_height, prev AS prev_block_hash, x AS merkle_root, t AS timestamp, '{G.METADATA}' AS metadata, own AS block_hash FROM ch"""


@query(duck(LEDGER + CHAIN).replace("WITH ", "WITH RECURSIVE ", 1))
def ledger_chain(spark, sf_dir):
    return G.ledger_chain(_alerts(spark, sf_dir)).drop("leaves")


@query(duck(LEDGER + " SELECT h AS block_height, CASE WHEN h % 5 = 3 THEN 'block_hash' ELSE '' END AS errors FROM b4"))
def verify_ledger(spark, sf_dir):
    blocks = G.ledger_chain(_alerts(spark, sf_dir))
    return G.verify_ledger(blocks.withColumn("timestamp", F.when(F.col("block_height") % 5 == 3, F.lit("2020-01-01T00:00:00Z")).otherwise(F.col("timestamp"))))


@query(duck(LEDGER + " SELECT h AS block_height, '' AS errors FROM b4"))
def read_ledger(spark, sf_dir):
    """A ledger written as JSON lines, read again and verified."""
    path = new_path(spark, "ledger")
    SF.write_ledger(G.ledger_chain(_alerts(spark, sf_dir)), path)
    return G.verify_ledger(SF.read_ledger(spark, path))


@query(duck(CA.AL + " SELECT alert_id, CASE WHEN substr(alert_id, 1, 1) = '0' THEN 'missing' WHEN substr(alert_id, 1, 1) = '1' THEN 'altered' WHEN substr(alert_id, 1, 1) = '2' THEN 'unsealed' ELSE 'sealed' END AS status FROM al"))
def alert_ledger_audit(spark, sf_dir):
    rows, one = _alerts(spark, sf_dir), F.substring("alert_id", 1, 1)
    blocks = G.ledger_chain(rows.where(one != "2"))
    return G.alert_ledger_audit(rows.where(one != "0").withColumn("severity", F.when(one == "1", "LOW").otherwise(F.col("severity"))), blocks)


@query(duck(LEDGER + " SELECT h AS block_height, '' AS violations FROM b4"))
def validate_blocks(spark, sf_dir):
    from ..functions.checks import validate_blocks as check

    return check(G.ledger_chain(_alerts(spark, sf_dir))).select("block_height", F.array_join("violations", ",").alias("violations"))
