from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, scalars as S
from ..operators import networks as N, templates as O
from ..plans.flow_view import duck, flow_view
from .registry import long, query, rounded, table

IP = "CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"
NETWORKS = [("default", "10.0.0.0/8"), ("lab", "10.0.0.0/16"), ("lab", "10.9.0.0/16")]


def networks(spark, scenario: str = "lab"):
    """Internal networks of a scenario, a fixed parameter of the direction queries."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(c).alias("cidr")) for s, c in NETWORKS]))
    return spark.range(1).select(rows.alias("r")).select("r.*").where(F.col("scenario") == scenario)


def hosts(spark, sf_dir):
    """(page_id, domain): the hosts of the pages' addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("domain"))


HOSTS = "h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS domain FROM pages)"
PORT_TEXT = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '0x' || lower(hex(dst_port)) WHEN 2 THEN CAST(dst_port AS {0}) WHEN 3 THEN 'https' WHEN 4 THEN 'domain' ELSE 'what' END"
STATE_TEXT = "CASE event_id % 7 WHEN 0 THEN 'S0' WHEN 1 THEN 'CON' WHEN 2 THEN 'FSPA_FSPA' WHEN 3 THEN 'INT' WHEN 4 THEN 'RST' WHEN 5 THEN 'EST' ELSE 'urp' END"


@query(duck(f" SELECT event_id, {PORT_TEXT.format('VARCHAR')} AS port_text, CAST(CASE event_id % 6 WHEN 1 THEN dst_port WHEN 2 THEN dst_port WHEN 3 THEN 443 WHEN 4 THEN 53 ELSE 0 END AS BIGINT) AS port FROM fv"))
def parse_flow_port(spark, sf_dir):
    return flow_view(spark, sf_dir).select("event_id", F.expr(PORT_TEXT.format("STRING")).alias("port_text")).withColumn("port", S.parse_flow_port(F.col("port_text")))


@query(duck(f", t AS (SELECT event_id, upper({STATE_TEXT}) AS s FROM fv) SELECT event_id, contains(s, 'S') AS syn, contains(s, 'A') OR contains(s, 'CON') OR contains(s, 'EST') AS ack, contains(s, 'F') AS fin, contains(s, 'R') AS rst, contains(s, 'P') AS psh, contains(s, 'U') AS urg FROM t"))
def parse_flow_state(spark, sf_dir):
    return flow_view(spark, sf_dir).select("event_id", S.parse_flow_state(F.expr(STATE_TEXT)).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE epoch_us(date_trunc('second', ts)) END AS ts_us FROM events")
def parse_flow_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss.'000000'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.'000000'")).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return rows.select("event_id", S.parse_flow_time(text).alias("ts_us"))


@query(duck(f" SELECT DISTINCT dst_ip, {IP.format('dst_ip')} AS n, ({IP.format('dst_ip')}) // 65536 * 65536 AS lo, ({IP.format('dst_ip')}) // 65536 * 65536 + 65535 AS hi FROM fv"))
def ip_to_long(spark, sf_dir):
    low, high = S.cidr_bounds(F.concat("dst_ip", F.lit("/16")))
    return flow_view(spark, sf_dir).select("dst_ip").distinct().select("dst_ip", S.ip_to_long(F.col("dst_ip")).alias("n"), low.alias("lo"), high.alias("hi"))


INSIDE = "({0} LIKE '10.0.%' OR {0} LIKE '10.9.%')"
DIRECTION = f"CASE WHEN {INSIDE.format('src_ip')} AND {INSIDE.format('dst_ip')} THEN 'LATERAL' WHEN {INSIDE.format('src_ip')} THEN 'OUTBOUND' WHEN {INSIDE.format('dst_ip')} THEN 'INBOUND' ELSE 'TRANSIT' END"


@query(duck(f" SELECT event_id, dst_ip, {INSIDE.format('dst_ip')} AS inside FROM fv"))
def ip_in_networks(spark, sf_dir):
    return N.ip_in_networks(flow_view(spark, sf_dir).select("event_id", "dst_ip"), networks(spark), "dst_ip")


@query(duck(f" SELECT event_id, src_ip, dst_ip, {DIRECTION} AS direction FROM fv"))
def classify_direction(spark, sf_dir):
    return N.classify_direction(flow_view(spark, sf_dir).select("event_id", "src_ip", "dst_ip"), networks(spark))


@query(duck(f", d AS (SELECT event_id, protocol, {DIRECTION} AS direction FROM fv) SELECT protocol, count(*) AS events, count(*) FILTER (WHERE direction <> 'OUTBOUND') AS mismatches, min(event_id) FILTER (WHERE direction <> 'OUTBOUND') AS sample_id FROM d GROUP BY ALL"))
def expect_direction(spark, sf_dir):
    return N.expect_direction(N.classify_direction(flow_view(spark, sf_dir), networks(spark)), "OUTBOUND", "protocol")


@query(duck(""" SELECT event_id, least((src_ip, src_port), (dst_ip, dst_port))[1] AS a_ip, CAST(least((src_ip, src_port), (dst_ip, dst_port))[2] AS INT) AS a_port, greatest((src_ip, src_port), (dst_ip, dst_port))[1] AS b_ip, CAST(greatest((src_ip, src_port), (dst_ip, dst_port))[2] AS INT) AS b_port,
 src_ip || ':' || src_port || '_' || dst_ip || ':' || dst_port || '_' || protocol AS flow_id FROM fv"""))
def canonical_flow_key(spark, sf_dir):
    rows = N.canonical_flow_key(flow_view(spark, sf_dir))
    return rows.select("event_id", F.col("ep_a.ip").alias("a_ip"), F.col("ep_a.port").alias("a_port"), F.col("ep_b.ip").alias("b_ip"), F.col("ep_b.port").alias("b_port"), "flow_id")


def _entropy_sql(key: str, text: str, source: str) -> str:
    return f"""c AS (SELECT {key}, ch, count(*) AS c FROM (SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {source} WHERE length({text}) > 0) GROUP BY ALL), e AS (SELECT {key}, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h FROM c GROUP BY ALL)"""


@query(f"WITH {_entropy_sql('page_id', 'url', 'pages')} SELECT page_id, round(coalesce(h, 0), 6) + 0.0 AS entropy FROM pages LEFT JOIN e USING (page_id)")
def shannon_entropy(spark, sf_dir):
    return rounded(table(spark, sf_dir, "pages").select("page_id", S.shannon_entropy(F.col("url")).alias("entropy")))


@query(f"WITH b AS (SELECT page_id, hex(encode(url)) AS x FROM pages), p AS (SELECT page_id, unnest(list_transform(range(0, length(x) // 2), lambda i: substr(x, 2 * i + 1, 2))) AS ch FROM b), c AS (SELECT page_id, ch, count(*) AS c FROM p GROUP BY ALL), e AS (SELECT page_id, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h FROM c GROUP BY ALL) SELECT page_id, round(coalesce(h, 0), 6) + 0.0 AS entropy FROM pages LEFT JOIN e USING (page_id)")
def byte_entropy(spark, sf_dir):
    return rounded(table(spark, sf_dir, "pages").select("page_id", S.byte_entropy(F.encode("url", "UTF-8")).alias("entropy")))


@query(f"""WITH {HOSTS}, l AS (SELECT page_id, domain, lower(split_part(domain, '.', 1)) AS label FROM h), {_entropy_sql('page_id', 'label', 'l')}
 SELECT l.page_id, domain, label, length(label) AS label_length, round(coalesce(h, 0), 6) + 0.0 AS label_entropy, round(CASE WHEN length(label) > 0 THEN length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) ELSE 0 END, 6) + 0.0 AS digit_ratio,
 round(CASE WHEN length(regexp_replace(label, '[^a-z]', '', 'g')) > 0 THEN length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(regexp_replace(label, '[^a-z]', '', 'g')) ELSE 0 END, 6) + 0.0 AS vowel_ratio FROM l LEFT JOIN e ON e.page_id = l.page_id""")
def domain_lexical(spark, sf_dir):
    return rounded(hosts(spark, sf_dir).select("page_id", "domain", *[c.alias(n) for n, c in S.lexical_features(F.col("domain")).items()]))


@query(duck(" SELECT DISTINCT src_ip, regexp_replace(src_ip, '[.][0-9]+$', '') || '.0/24' AS subnet FROM fv"))
def subnet_group(spark, sf_dir):
    return flow_view(spark, sf_dir).select("src_ip").distinct().withColumn("subnet", S.subnet_group(F.col("src_ip")))


@query(duck(""", s AS (SELECT src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS r, CASE WHEN syn THEN length ELSE -(length % 700) END AS z FROM fv),
 p AS (SELECT src_ip, abs(z) AS a, abs(lead(z) OVER (PARTITION BY src_ip ORDER BY r)) AS b FROM s WHERE r <= 10)
 SELECT src_ip, count(*) FILTER (WHERE (a BETWEEN 128 AND 512 AND b BETWEEN 1024 AND 4096) OR (b BETWEEN 128 AND 512 AND a BETWEEN 1024 AND 4096)) AS pairs FROM p GROUP BY src_ip"""))
def pst_pattern_matches(spark, sf_dir):
    from pyspark.sql import Window

    flows = flow_view(spark, sf_dir).withColumn("z", F.when(F.col("syn"), F.col("length")).otherwise(-(F.col("length") % 700)))
    first = flows.withColumn("r", F.row_number().over(Window.partitionBy("src_ip").orderBy("ts_us", "event_id"))).where("r <= 10")
    sizes = first.groupBy("src_ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "z"))), lambda x: x["z"]).alias("sizes"))
    return sizes.select("src_ip", S.pst_pattern_matches(F.col("sizes")).alias("pairs"))


@query("SELECT event_id, round(1 / (1 + exp(10 * (value / 490 - 0.5))), 6) + 0.0 AS prob, round(greatest(least(value / 400, 1), 1 / (1 + exp(10 * (value / 490 - 0.5)))), 6) + 0.0 AS fused FROM events")
def anomaly_to_prob(spark, sf_dir):
    prob = S.anomaly_to_prob(F.col("value") / 490 - 0.5)
    return rounded(table(spark, sf_dir, "events").select("event_id", prob.alias("prob"), S.fuse_score(F.col("value") / 400, prob).alias("fused")))


BAD = "src_port - CASE WHEN event_id % 11 = 0 THEN 70000 ELSE 0 END AS src_port, dst_port, length - CASE WHEN event_id % 13 = 0 THEN 100000 ELSE 0 END AS length, CASE WHEN event_id % 5 = 0 THEN 9.5 WHEN event_id % 5 = 1 THEN 3.5 END AS payload_entropy"


@query(duck(f", b AS (SELECT event_id, {BAD} FROM fv) SELECT event_id, concat_ws(',', CASE WHEN NOT src_port BETWEEN 0 AND 65535 THEN 'src_port' END, CASE WHEN NOT dst_port BETWEEN 0 AND 65535 THEN 'dst_port' END, CASE WHEN NOT length >= 0 THEN 'length' END, CASE WHEN payload_entropy NOT BETWEEN 0 AND 8 THEN 'payload_entropy' END) AS violations FROM b"))
def validate_events(spark, sf_dir):
    rows = flow_view(spark, sf_dir).selectExpr("event_id", *[x.strip() for x in BAD.split(", ") if x])
    return checks.validate_events(rows).select("event_id", F.array_join("violations", ",").alias("violations"))


@query(duck(", i AS (SELECT md5(CAST(i AS VARCHAR)) AS ja3, 'family' || (i % 3) AS family FROM range(0, 12, 2) r(i)) SELECT event_id, tls_ja3, family, CASE WHEN family IS NOT NULL THEN 0.95 ELSE 0 END + 0.0 AS ja3_score FROM fv LEFT JOIN i ON i.ja3 = fv.tls_ja3 WHERE tls_ja3 IS NOT NULL"))
def ja3_intel_join(spark, sf_dir):
    flows = flow_view(spark, sf_dir).where("tls_ja3 is not null").select("event_id", "tls_ja3")
    return N.ja3_intel_join(flows, ja3_intel(spark)).withColumn("ja3_score", F.col("ja3_score") + 0.0)


def ja3_intel(spark):
    """Six known fingerprints, a fixed parameter: they stand for an intelligence feed."""
    return spark.range(0, 12, 2).select(F.md5(F.col("id").cast("string")).alias("ja3"), F.concat(F.lit("family"), (F.col("id") % 3).cast("string")).alias("family"))


@query("""WITH t AS (SELECT user_id % 5 AS source_id, event_id % 3 AS template_id, event_id AS seq, 'f' || event_id AS fields FROM events WHERE event_id % 97 = 50),
 d AS (SELECT user_id % 5 AS source_id, event_id % 3 AS template_id, event_id AS seq, value FROM events WHERE event_id % 97 <> 50)
 SELECT source_id, template_id, seq, round(value, 6) + 0.0 AS value, coalesce(b, a) AS fields, CASE WHEN b IS NOT NULL THEN 'before' WHEN a IS NOT NULL THEN 'after' ELSE 'none' END AS resolution
 FROM (SELECT d.*, (SELECT arg_max(fields, t.seq) FROM t WHERE t.source_id = d.source_id AND t.template_id = d.template_id AND t.seq <= d.seq) AS b, (SELECT arg_min(fields, t.seq) FROM t WHERE t.source_id = d.source_id AND t.template_id = d.template_id AND t.seq > d.seq) AS a FROM d)""")
def netflow_template_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("source_id"), (F.col("event_id") % 3).alias("template_id"), F.col("event_id").alias("seq"), "value")
    marks = rows.where("seq % 97 = 50").withColumn("fields", F.concat(F.lit("f"), F.col("seq").cast("string"))).drop("value")
    return rounded(O.template_join(rows.where("seq % 97 <> 50"), marks))


@query("""WITH s AS (SELECT source AS grp, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents),
 p AS (SELECT 'train' AS a, 'val' AS b UNION ALL SELECT 'train', 'test' UNION ALL SELECT 'val', 'test')
 SELECT a, b, (SELECT count(*) FROM (SELECT grp FROM s WHERE split = a INTERSECT SELECT grp FROM s WHERE split = b)) AS shared FROM p""")
def disjoint_splits(spark, sf_dir):
    k = long("doc_id") % 10
    return N.disjoint_splits(table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.when(k < 6, "train").when(k < 8, "val").otherwise("test").alias("split")))
