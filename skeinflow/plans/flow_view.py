"""The flow table that the registered queries read: a view of ``events`` with the same rows in Spark and in SQL engines.

``FLOW`` has one flow event for each event; ``SESSION`` adds a reverse direction, sequence numbers and payload lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOW = """
SELECT event_id, {EPOCH_US} AS ts_us,
  '10.' || CAST(user_id % 4 AS {STR}) || '.' || CAST(CAST(floor(user_id / 4) AS BIGINT) % 8 AS {STR}) || '.' || CAST(user_id % 250 + 1 AS {STR}) AS src_ip,
  CAST(1024 + (event_id * 7919) % 60000 AS INT) AS src_port,
  CASE WHEN event_id % 5 = 0 THEN '10.9.0.' ELSE '203.0.113.' END || CAST((user_id * 7 + event_id % 3) % 40 + 1 AS {STR}) AS dst_ip,
  CAST(CASE WHEN event_type = 'error' THEN 1 + (event_id * 31) % 1024 WHEN event_type = 'view' THEN 53 ELSE 443 END AS INT) AS dst_port,
  CASE WHEN event_type = 'view' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CAST(floor(value * 100) AS BIGINT) + 40 AS length,
  event_type <> 'view' AND (event_type = 'error' OR event_id % 4 = 0) AS syn,
  event_type <> 'view' AND event_type <> 'error' AND event_id % 4 <> 0 AS ack,
  event_type <> 'view' AND event_id % 16 = 15 AS fin,
  event_type <> 'view' AND event_id % 64 = 63 AS rst,
  CASE WHEN event_type = 'view' THEN substr(md5(CAST(event_id % 500 AS {STR})), 1, CAST(6 + event_id % 26 AS INT)) || '.example.com' END AS dns_query,
  CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'TXT' ELSE 'A' END END AS dns_qtype,
  CASE WHEN event_type = 'purchase' THEN md5(CAST(user_id % 12 AS {STR})) END AS tls_ja3, user_id
FROM {EVENTS}
"""

SESSION = """
SELECT event_id, ts_us,
  CASE WHEN event_id % 2 = 1 THEN rip ELSE src_ip END AS src_ip, CASE WHEN event_id % 2 = 1 THEN 443 ELSE 40000 END AS src_port,
  CASE WHEN event_id % 2 = 1 THEN src_ip ELSE rip END AS dst_ip, CASE WHEN event_id % 2 = 1 THEN 40000 ELSE 443 END AS dst_port,
  'TCP' AS protocol, length, syn AND event_id % 16 < 4 AS syn, event_id % 16 > 1 AS ack, fin, rst,
  CAST(1000 + (event_id % 7) * 100 AS BIGINT) AS tcp_seq, length % 200 AS payload_len, tls_ja3
FROM (SELECT *, '203.0.113.' || CAST(user_id % 20 + 1 AS {STR}) AS rip FROM ({FLOW}) f) k
"""

_SPARK = {"STR": "STRING", "EPOCH_US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))", "EVENTS": "{events}"}
_DUCK = {"STR": "VARCHAR", "EPOCH_US": "epoch_us(ts)", "EVENTS": "events"}

DAY_US = 86_400_000_000


def _text(sql: str, dialect: dict[str, str]) -> str:
    return sql.format(**dialect, FLOW=FLOW.format(**dialect))


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_text(FLOW, _SPARK), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_text(SESSION, _SPARK), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def duck(sql: str) -> str:
    """``sql`` with the views ``fv`` and ``sv`` in front, for DuckDB; further CTEs may start with a comma."""
    head = f"WITH fv AS ({_text(FLOW, _DUCK)}), sv AS ({_text(SESSION, _DUCK)})"
    return f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head} {sql}"
