from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import incidents as I, lexical as L, networks as N, rules as R, sessions as X, windows as W
from ..plans.flow_view import DAY_US, duck, flow_view
from ..plans.stages import settle
from . import scalars as C, sessions as XC, windows as WC
from .registry import query, rounded

#: The view's events stand minutes apart, so rates and counts are scaled to it; the rules are the same.
T = R.Thresholds(
    ddos={"syn_ack_ratio": 2.0, "pps": 0.0, "src_entropy": 2.5, "entropy_pps": 0.0, "amplification": 60_000.0, "amp_pps": 0.0, "alert": 0.70, "min_n": 2},
    scan={"ports": 3, "syn_ratio": 0.65, "ips": 3, "slow_ports": 3, "slow_window_s": 60.0, "alert": 0.70},
    beacon={"samples": 8, "min_iat": 0.5, "max_iat": 1e6, "rigid_cv": 0.60, "jitter_cv": 0.90, "acf": 0.30, "skip_cv": 1.5, "skip_acf": 0.05, "alert": 0.70},
    dga=R.DEFAULTS.dga, tunnel={"queries": 5, "avg_length": 30.0, "txt": 0.50, "entropy": 3.6, "alert": 0.70}, tls=R.DEFAULTS.tls,
    exfil={"ratio": 3.0, "egress": 50_000, "slow_ratio": 2.0, "slow_egress": 10_000, "slow_s": 120.0, "alert": 0.70},
)


class Inputs:
    """What detectors read. With ``shared``, what two of them need is written once."""

    def __init__(self, spark, sf_dir, shared: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.keep = settle if shared else lambda df, name: df

    @cached_property
    def flows(self) -> DataFrame:
        return flow_view(self.spark, self.sf_dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.keep(XC.sessions(self.spark, self.sf_dir), "sessions")

    @cached_property
    def names(self) -> DataFrame:
        return self.keep(names(self.flows), "names")

    def prepare(self) -> Inputs:
        """What is written once is written at the same time: three jobs that do not need each other."""
        run = [inheritable_thread_target(self.spark)(partial(getattr, self, name)) for name in ("sessions", "model", "names")]
        with ThreadPoolExecutor(len(run)) as pool:
            for job in [pool.submit(r) for r in run]:
                job.result()
        return self

    @cached_property
    def model(self) -> DataFrame:
        return self.keep(L.train_trigram_lm(C.hosts(self.spark, self.sf_dir).select("domain")), "model")


def ddos(inputs: Inputs) -> DataFrame:
    return R.detect_ddos(W.dst_window_features(inputs.flows, DAY_US), T)


def port_scan(inputs: Inputs) -> DataFrame:
    return R.detect_port_scan(W.src_window_features(inputs.flows, DAY_US), DAY_US / 1e6, T)


def beacon(inputs: Inputs) -> DataFrame:
    return R.detect_beacon(W.pair_features(inputs.flows).withColumnRenamed("last_us", "ts_us"), T)


def names(flows: DataFrame) -> DataFrame:
    """(domain, ts_us): each name asked for, with its last time."""
    return flows.where("dns_query is not null").groupBy(F.col("dns_query").alias("domain")).agg(F.max("ts_us").alias("ts_us"))


def dga(inputs: Inputs) -> DataFrame:
    rows = inputs.names
    lexical = rows.select("domain", "ts_us", *[c.alias(n) for n, c in S.lexical_features(F.col("domain")).items()])
    return R.detect_dga(lexical.join(L.trigram_perplexity(rows, inputs.model, "domain"), "domain"), T)


def dns_tunnel(inputs: Inputs) -> DataFrame:
    return R.detect_dns_tunnel(W.domain_features(inputs.flows).withColumnRenamed("last_us", "ts_us"), T)


def tls(inputs: Inputs) -> DataFrame:
    flows = X.tls_flow_features(inputs.sessions).withColumnRenamed("start_us", "ts_us")
    return R.detect_tls(N.ja3_intel_join(flows, C.ja3_intel(inputs.spark)), T)


def exfil(inputs: Inputs) -> DataFrame:
    return R.detect_exfil(X.exfil_features(inputs.sessions), T)


DETECTORS = (ddos, port_scan, beacon, dga, dns_tunnel, tls, exfil)


def detections(inputs: Inputs, detectors=DETECTORS) -> DataFrame:
    return reduce(DataFrame.unionByName, [d(inputs) for d in detectors])


def incidents(spark, sf_dir) -> DataFrame:
    return I.dedup_incidents(detections(Inputs(spark, sf_dir, shared=True).prepare()), 2 * DAY_US)


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: e["feature"]), ",")))


def _sql(cls: str, source: str, entity: str, ts: str, rules: list[tuple[str, str, float]], critical: float, names: tuple[str, str], technique: str, where: str = "true") -> str:
    """The detector's alerts from the CTE ``source``."""
    score = "greatest(0, " + ", ".join(f"CASE WHEN {cond} THEN {s} ELSE 0 END" for _, cond, s in rules) + ")"
    found = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{f}' END" for f, cond, _ in rules) + ")"
    alert = T.tls["alert"] if cls == "TLS_MALWARE" else 0.7
    return f"""SELECT ts_us, threat_class, entity_id, s + 0.0 AS rule_score, s + 0.0 AS confidence, CASE WHEN s >= {critical} THEN '{names[0]}' ELSE '{names[1]}' END AS severity, technique, evidence
 FROM (SELECT {ts} AS ts_us, '{cls}' AS threat_class, {entity} AS entity_id, CAST({score} AS DOUBLE) AS s, {technique} AS technique, {found} AS evidence FROM {source} WHERE {where}) WHERE s >= {alert}"""


d, sc, be, dg, tu, ex = T.ddos, T.scan, T.beacon, T.dga, T.tunnel, T.exfil
AMP = f"amplification >= {d['amplification']} AND pps >= {d['amp_pps']}"
FLOOD = f"syn_ack_ratio >= {d['syn_ack_ratio']} AND pps >= {d['pps']} AND n >= {d['min_n']}"
SQL = {
    "ddos": _sql("VOLUMETRIC_DDOS", "dst", "dst_ip", "window_us", [("syn_to_ack_ratio", FLOOD, 0.9), ("incoming_pps", FLOOD, 0.9), ("src_ip_entropy", f"src_entropy >= {d['src_entropy']} AND pps >= {d['entropy_pps']}", 0.85), ("udp_amplification", AMP, 0.92)], 0.9, ("CRITICAL", "HIGH"), f"CASE WHEN {AMP} THEN 'T1498.002' ELSE 'T1498.001' END"),
    "port_scan": _sql("PORT_SCANNING", "src", "src_ip", "window_us", [("distinct_dst_ports", f"dst_ports >= {sc['ports']} AND syn_ratio >= {sc['syn_ratio']}", 0.92), ("distinct_dst_ips", f"dst_ips >= {sc['ips']} AND syn_ratio >= {sc['syn_ratio']}", 0.88), ("slow_scan_ports", f"dst_ports >= {sc['slow_ports']}", 0.75)], 0.85, ("HIGH", "MEDIUM"), "'T1046'"),
    "beacon": _sql("C2_BEACONING", "(SELECT *, coalesce(iat_cv, 1) AS cv FROM pair)", "src_ip || '->' || dst_ip", "last_us", [("iat_cv", f"cv < {be['rigid_cv']}", 0.92), ("iat_autocorr", f"cv >= {be['rigid_cv']} AND cv < {be['jitter_cv']} AND iat_autocorr > {be['acf']}", 0.85)], 0.9, ("CRITICAL", "HIGH"), "'T1071.001'", f"samples >= {be['samples']} AND iat_mean BETWEEN {be['min_iat']} AND {be['max_iat']} AND NOT (cv > {be['skip_cv']} AND iat_autocorr < {be['skip_acf']})"),
    "dga": _sql("DGA_DOMAIN", "lex", "domain", "ts_us", [("trigram_perplexity", f"perplexity >= {dg['perplexity']}", 0.88), ("label_entropy", f"label_entropy >= {dg['entropy']}", 0.82), ("digit_ratio", f"label_length >= {dg['length']} AND digit_ratio >= {dg['digits']}", 0.80)], 0.9, ("HIGH", "MEDIUM"), "'T1568.002'", f"label_length >= {dg['min_label']} AND (label_entropy >= 3 OR perplexity >= 50 OR label_length >= 14 OR digit_ratio >= 0.25)"),
    "dns_tunnel": _sql("DNS_TUNNELLING", "dom", "client || '->' || domain", "last_us", [("avg_query_length", f"avg_length >= {tu['avg_length']}", 0.9), ("txt_ratio", f"txt_ratio >= {tu['txt']}", 0.87), ("max_query_entropy", f"max_entropy >= {tu['entropy']}", 0.83)], 0.9, ("CRITICAL", "HIGH"), "'T1071.004'", f"queries >= {tu['queries']}"),
    "tls": _sql("TLS_MALWARE", "tlsf", "initiator || '->' || responder", "start_us", [("ja3_intel", "known", 0.95), ("packet_size_pairs", "pairs >= 1", 0.85)], 0.9, ("CRITICAL", "HIGH"), "'T1071.001'"),
    "exfil": _sql("DATA_EXFILTRATION", "(SELECT *, fwd_bytes / (rev_bytes + 1) AS ratio, CASE WHEN initiator = ep_a THEN ep_b ELSE ep_a END AS responder FROM ses)", "initiator || '->' || responder", "start_us", [("egress_ratio", f"ratio >= {ex['ratio']} AND fwd_bytes >= {ex['egress']}", 0.9), ("slow_egress_ratio", f"ratio >= {ex['slow_ratio']} AND duration_s >= {ex['slow_s']} AND fwd_bytes >= {ex['slow_egress']}", 0.8)], 0.88, ("CRITICAL", "HIGH"), "'T1048.003'"),
}
GRAMS = "SELECT {key}, substr('^^' || label || '{end}', i, 2) AS ctx, substr('^^' || label || '{end}', i + 2, 1) AS ch FROM (SELECT {key}, label, unnest(range(1, length(label) + {n})) AS i FROM {source})"
LM = f""", host AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS domain FROM pages),
 hg AS ({GRAMS.format(key='page_id', end='$', n=2, source="(SELECT page_id, lower(domain) AS label FROM host WHERE length(domain) > 0)")}),
 hc AS (SELECT ctx, ch, count(*) AS n FROM hg GROUP BY ALL), ht AS (SELECT ctx, sum(n) + {len(L.VOCABULARY)} AS total FROM hc GROUP BY ctx),
 voc AS (SELECT unnest(list_concat(string_split('{L.VOCABULARY}', ''), ['_unk_'])) AS ch), lm AS (SELECT ht.ctx, voc.ch, (coalesce(hc.n, 0) + 1) / total AS p FROM ht CROSS JOIN voc LEFT JOIN hc ON hc.ctx = ht.ctx AND hc.ch = voc.ch)"""
NAMES = f""", nm AS (SELECT dns_query AS domain, lower(split_part(dns_query, '.', 1)) AS label, max(ts_us) AS ts_us FROM fv WHERE dns_query IS NOT NULL GROUP BY ALL),
 ng AS ({GRAMS.format(key='label', end='', n=1, source="(SELECT DISTINCT label FROM nm WHERE length(label) >= 3)")}),
 pp AS (SELECT label, exp(-avg(ln(greatest(coalesce(a.p, b.p, {L.FLOOR}), {L.FLOOR})))) AS perplexity FROM ng LEFT JOIN lm a ON a.ctx = ng.ctx AND a.ch = ng.ch LEFT JOIN lm b ON b.ctx = ng.ctx AND b.ch = '_unk_' GROUP BY label),
 nc AS (SELECT label, ch, count(*) AS c FROM (SELECT label, unnest(string_split(label, '')) AS ch FROM (SELECT DISTINCT label FROM nm)) GROUP BY ALL), ne AS (SELECT label, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h FROM nc GROUP BY label),
 lex AS (SELECT domain, nm.label, ts_us, length(nm.label) AS label_length, coalesce(h, 0) AS label_entropy, CASE WHEN length(nm.label) > 0 THEN length(regexp_replace(nm.label, '[^0-9]', '', 'g')) / length(nm.label) ELSE 0 END AS digit_ratio, coalesce(perplexity, {L.SHORT}) AS perplexity
  FROM nm LEFT JOIN pp ON pp.label = nm.label LEFT JOIN ne ON ne.label = nm.label)"""
TLSF = """, intel AS (SELECT md5(CAST(i AS VARCHAR)) AS ja3 FROM range(0, 12, 2) r(i)),
 tp AS (SELECT ep_a, ep_b, protocol, CAST(session AS BIGINT) AS session, length AS a, lead(length) OVER (PARTITION BY ep_a, ep_b, protocol, session ORDER BY place) AS b FROM r WHERE place <= 10),
 tc AS (SELECT ep_a, ep_b, protocol, session, count(*) FILTER (WHERE (a BETWEEN 128 AND 512 AND b BETWEEN 1024 AND 4096) OR (b BETWEEN 128 AND 512 AND a BETWEEN 1024 AND 4096)) AS pairs FROM tp GROUP BY ALL),
 tlsf AS (SELECT ses.*, pairs, CASE WHEN initiator = ses.ep_a THEN ses.ep_b ELSE ses.ep_a END AS responder, tls_ja3 IN (SELECT ja3 FROM intel) AS known FROM ses JOIN tc ON tc.ep_a = ses.ep_a AND tc.ep_b = ses.ep_b AND tc.protocol = ses.protocol AND tc.session = ses.session WHERE tls_ja3 IS NOT NULL)"""
NEEDS = {"ddos": WC.DST, "port_scan": WC.SRC, "beacon": WC.PAIR, "dga": LM + NAMES, "dns_tunnel": WC.DOMAIN, "tls": XC.BASE + TLSF, "exfil": XC.BASE}
ALL = WC.DST + WC.SRC + WC.PAIR.replace(" k AS", " pk AS").replace("FROM k WHERE", "FROM pk WHERE").replace(" l AS (", " pl AS (").replace("k2 JOIN l USING", "k2 JOIN pl USING").replace("FROM l) l LEFT", "FROM pl) l LEFT").replace(" g AS (", " pg AS (").replace("FROM g a JOIN g b", "FROM pg a JOIN pg b") + LM + NAMES + WC.DOMAIN.replace(" e AS (", " de AS (").replace("JOIN e ON e.label", "JOIN de ON de.label") + XC.BASE.replace(" d AS", " d AS").replace(", e AS (SELECT *, src_ip", ", xe AS (SELECT *, src_ip").replace("FROM e)", "FROM xe)") + TLSF
RAW = ALL + ", raw AS (" + " UNION ALL ".join(SQL.values()) + ")"
INCIDENTS = RAW + f""", ig AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {2 * DAY_US} THEN 0 ELSE 1 END AS new FROM raw WINDOW w AS (PARTITION BY threat_class, entity_id ORDER BY ts_us, confidence)),
 inn AS (SELECT *, sum(new) OVER (PARTITION BY threat_class, entity_id ORDER BY ts_us, confidence ROWS UNBOUNDED PRECEDING) AS incident FROM ig),
 ia AS (SELECT threat_class, entity_id, incident, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS detections, max((confidence, ts_us, severity, technique)) AS peak FROM inn GROUP BY ALL),
 ie AS (SELECT threat_class, entity_id, incident, string_agg(f, ',' ORDER BY f) AS ev FROM (SELECT DISTINCT threat_class, entity_id, incident, unnest(string_split(evidence, ',')) AS f FROM inn) GROUP BY ALL),
 alerts AS (SELECT substr(sha256(ia.threat_class || '|' || ia.entity_id || '|' || first_us), 1, 32) AS alert_id, ia.threat_class, ia.entity_id, first_us, last_us, detections, peak[1] + 0.0 AS confidence, peak[3] AS severity, peak[4] AS technique,
  ev || CASE WHEN detections > 1 THEN ',incident_cluster_size' ELSE '' END AS evidence FROM ia JOIN ie ON ie.threat_class = ia.threat_class AND ie.entity_id = ia.entity_id AND ie.incident = ia.incident)"""


def _register(f, name: str) -> None:
    query(duck(NEEDS[f.__name__] + " " + SQL[f.__name__]), name)(lambda spark, sf_dir: _shown(f(Inputs(spark, sf_dir))))


for _f, _n in zip(DETECTORS, ("detect_ddos", "detect_port_scan", "detect_beacon", "detect_dga", "detect_dns_tunnel", "detect_tls", "detect_exfil")):
    _register(_f, _n)


@query(duck(INCIDENTS + " SELECT * FROM alerts"))
def run_detectors(spark, sf_dir):
    return _shown(incidents(spark, sf_dir))


@query(duck(NEEDS["ddos"] + ", raw AS (" + SQL["ddos"] + ")" + INCIDENTS[len(RAW):] + " SELECT entity_id, first_us, last_us, detections, confidence, severity, evidence FROM alerts"))
def dedup_incidents(spark, sf_dir):
    return _shown(I.dedup_incidents(ddos(Inputs(spark, sf_dir)), 2 * DAY_US).select("entity_id", "first_us", "last_us", "detections", "confidence", "severity", "evidence"))


@query(duck(LM + " SELECT ctx, ch, round(p, 6) + 0.0 AS p FROM lm"))
def train_trigram_lm(spark, sf_dir):
    return rounded(L.train_trigram_lm(C.hosts(spark, sf_dir).select("domain")))


@query(duck(LM + NAMES + " SELECT domain, round(perplexity, 6) + 0.0 AS perplexity FROM lex"))
def trigram_perplexity(spark, sf_dir):
    return rounded(L.trigram_perplexity(names(flow_view(spark, sf_dir)), L.train_trigram_lm(C.hosts(spark, sf_dir).select("domain")), "domain"))
