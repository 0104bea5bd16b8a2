"""Aggregates by destination, source, host pair and domain, over tumbling windows or trailing ones.

Flow events have ts_us (microseconds), src_ip, dst_ip, dst_port, protocol, length, syn, ack, and dns_query, dns_qtype for
names. Entropies come from counts, H = log2 n - sum(c log2 c) / n, so a destination under flood is summed by source first
and no key's events are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import autocorr_peak, shannon_entropy
from . import sweeps as S


def window_start(window_us: int) -> Column:
    return (F.floor(F.col("ts_us") / window_us).cast("long") * window_us).alias("window_us")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def entropy_of(n: Column, c_log_c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log2(n.cast("double")) - c_log_c / n)


def c_log_c(count: str) -> Column:
    return F.sum(F.col(count) * F.log2(F.col(count).cast("double")))


def in_windows(panes: DataFrame, window_us: int, slide_us: int | None) -> DataFrame:
    """Rows summed by panes of the slide (``window_us`` is a pane's start) -> a row for each window that the pane is part of."""
    if not slide_us or slide_us == window_us:
        return panes
    back = F.sequence(F.lit(0), F.lit(window_us - slide_us), F.lit(slide_us))
    return panes.withColumn("window_us", F.explode(F.transform(back, lambda b: F.col("window_us") - b)))


def pane_start(window_us: int, slide_us: int | None) -> Column:
    if slide_us and window_us % slide_us:
        raise ValueError("a window is a whole number of slides")
    return window_start(slide_us or window_us)


def dst_window_features(flows: DataFrame, window_us: int, reverse_bytes: bool = True, slide_us: int | None = None) -> DataFrame:
    """By destination and window: events, rate, SYNs, ACKs, their ratio, entropy of the sources, UDP bytes in and out and
    their ratio. With ``reverse_bytes`` false there are no bytes out. Windows overlap with a shorter slide: then events are
    summed by slide first."""
    seconds = window_us / 1e6
    udp_in = F.sum(F.when(F.col("protocol") == "UDP", F.col("length")).otherwise(0))
    by_source = flows.groupBy(pane_start(window_us, slide_us), "dst_ip", "src_ip").agg(F.count("*").alias("c"), count_if(F.col("syn")).alias("syn"), count_if(F.col("ack")).alias("ack"), udp_in.alias("udp_in"))
    if slide_us:
        by_source = in_windows(by_source, window_us, slide_us).groupBy("window_us", "dst_ip", "src_ip").agg(*[F.sum(c).alias(c) for c in ("c", "syn", "ack", "udp_in")])
    out = by_source.groupBy("window_us", "dst_ip").agg(F.sum("c").alias("n"), F.sum("syn").alias("syn"), F.sum("ack").alias("ack"), c_log_c("c").alias("clogc"), F.sum("udp_in").alias("udp_bytes_in"))
    if reverse_bytes:
        sent = flows.where("protocol = 'UDP'").groupBy(pane_start(window_us, slide_us), F.col("src_ip").alias("dst_ip")).agg(F.sum("length").alias("udp_bytes_out"))
        if slide_us:
            sent = in_windows(sent, window_us, slide_us).groupBy("window_us", "dst_ip").agg(F.sum("udp_bytes_out").alias("udp_bytes_out"))
        out = out.join(sent, ["window_us", "dst_ip"], "left").withColumn("udp_bytes_out", F.coalesce("udp_bytes_out", F.lit(0)).cast("long"))
    else:
        out = out.withColumn("udp_bytes_out", F.lit(0).cast("long"))
    return out.select(
        "window_us", "dst_ip", F.col("n").cast("long").alias("n"), (F.col("n") / seconds).alias("pps"), "syn", "ack",
        (F.col("syn") / (F.col("ack") + 1)).alias("syn_ack_ratio"), entropy_of(F.col("n"), F.col("clogc")).alias("src_entropy"), "udp_bytes_in", "udp_bytes_out",
        F.when(F.col("udp_bytes_in") > 0, F.col("udp_bytes_in") / (F.col("udp_bytes_out") + 1)).otherwise(0.0).alias("amplification"),
    )


def src_window_features(flows: DataFrame, window_us: int, slide_us: int | None = None) -> DataFrame:
    """By source and window, which may slide: events, distinct destination ports and addresses, SYNs and their share."""
    if slide_us:
        panes = flows.groupBy(pane_start(window_us, slide_us), "src_ip", "dst_port", "dst_ip").agg(F.count("*").alias("c"), count_if(F.col("syn")).alias("syn"))
        n, syn, rows = F.sum("c"), F.sum("syn"), in_windows(panes, window_us, slide_us).groupBy("window_us", "src_ip")
    else:
        n, syn, rows = F.count("*"), count_if(F.col("syn")), flows.groupBy(window_start(window_us), "src_ip")
    out = rows.agg(n.alias("n"), F.count_distinct("dst_port").alias("dst_ports"), F.count_distinct("dst_ip").alias("dst_ips"), syn.alias("syn"))
    return out.withColumn("syn_ratio", F.col("syn") / F.col("n"))


def categorical_entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Events, distinct categories and entropy of the category by ``keys``."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("categories"), c_log_c("c").alias("clogc"))
    return out.select(*keys, "n", "categories", entropy_of(F.col("n"), F.col("clogc")).alias("entropy"))


def pair_gaps(flows: DataFrame, max_samples: int = 64, min_gap_s: float = 0.05) -> DataFrame:
    """By host pair: events among the newest ``max_samples``, and the gaps over ``min_gap_s`` between them, in order."""
    newest = Window.partitionBy("src_ip", "dst_ip").orderBy(F.desc("ts_us"), F.desc("event_id"))
    kept = flows.select("src_ip", "dst_ip", "ts_us", "event_id", F.row_number().over(newest).alias("r")).where(F.col("r") <= max_samples)
    before = F.lead("ts_us").over(newest)
    gaps = kept.withColumn("gap", (F.col("ts_us") - before) / 1e6).withColumn("gap", F.when(F.col("gap") > min_gap_s, F.col("gap")))
    listed = F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct((-F.col("r")).alias("o"), "gap"))))
    out = gaps.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("samples"), F.max("ts_us").alias("last_us"), listed.alias("g"))
    return out.select("src_ip", "dst_ip", "samples", "last_us", F.transform("g", lambda x: x["gap"]).alias("gaps"))


def pair_features(flows: DataFrame, max_samples: int = 64, parity: bool = False) -> DataFrame:
    """By host pair: samples, and the gaps' mean, deviation, variation and autocorrelation peak.

    They need four samples and three gaps; without them the variation is null, or everything is 0 with ``parity``."""
    gaps = pair_gaps(flows, max_samples)
    n = F.size("gaps")
    enough = (F.col("samples") >= 4) & (n >= 3)
    mean = F.aggregate("gaps", F.lit(0.0), lambda s, x: s + x) / n
    gaps = gaps.withColumn("mean", F.when(enough, mean))
    square = F.aggregate(F.transform("gaps", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x)
    gaps = gaps.withColumn("std", F.when(enough, F.sqrt(square / n)))
    missing = F.lit(0.0) if parity else F.lit(None).cast("double")
    return gaps.select(
        "src_ip", "dst_ip", "samples", "last_us", F.coalesce("mean", F.lit(0.0)).alias("iat_mean"), F.coalesce("std", F.lit(0.0)).alias("iat_std"),
        F.coalesce(F.col("std") / F.col("mean"), missing).alias("iat_cv"), F.when(enough, autocorr_peak(F.col("gaps"))).otherwise(0.0).alias("iat_autocorr"),
    )


def domain_key(name: Column, key: str) -> Column:
    """The whole name, or the name without its first label where it has more than one."""
    if key == "full":
        return name
    return F.when(name.contains("."), F.regexp_replace(name, "^[^.]*\\.", "")).otherwise(name)


def domain_features(flows: DataFrame, key: str = "parent", newest: int = 50) -> DataFrame:
    """By client and domain: queries and share of TXT ones over all, mean length and largest entropy of the newest names."""
    rows = flows.where("dns_query is not null").select(F.col("src_ip").alias("client"), domain_key(F.col("dns_query"), key).alias("domain"), "dns_query", "dns_qtype", "ts_us", "event_id")
    order = Window.partitionBy("client", "domain").orderBy(F.desc("ts_us"), F.desc("event_id"))
    totals = rows.groupBy("client", "domain").agg(F.count("*").alias("queries"), F.max("ts_us").alias("last_us"), count_if(F.col("dns_qtype") == "TXT").alias("txt"))
    # only the newest of each task are ordered with those of the others
    late = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= newest)
    late = late.groupBy("client", "domain").agg(F.avg(F.length("dns_query")).alias("avg_length"), F.max(shannon_entropy(F.split_part("dns_query", F.lit("."), F.lit(1)))).alias("max_entropy"))
    return totals.join(late, ["client", "domain"]).select("client", "domain", "queries", "last_us", "avg_length", "max_entropy", (F.col("txt") / F.col("queries")).alias("txt_ratio"))


def periodicity_flags(pairs: DataFrame, spectral: Column | None = None) -> DataFrame:
    """``pairs`` with ``rigid`` (variation under 0.22) and ``jittered`` (under 0.38 with a clear peak)."""
    power = spectral if spectral is not None else F.lit(0.0)
    rigid = F.coalesce(F.col("iat_cv") < 0.22, F.lit(False))
    jittered = F.coalesce((F.col("iat_cv") < 0.38) & ((F.col("iat_autocorr") > 0.5) | (power > 0.3)), F.lit(False))
    return pairs.withColumn("rigid", rigid).withColumn("jittered", jittered)


def dst_sliding_features(flows: DataFrame, window_us: int) -> DataFrame:
    """For each event, its destination over the trailing window, both ends included; events of one time are peers. Events
    without a destination have no row."""
    found = S.trailing(flows, "dst_ip", window_us, {"syn": F.col("syn"), "ack": F.col("ack")}, {"spread": ("src_ip", S.c_log_c)})
    rows = S.at_events(flows, "dst_ip", found)
    return rows.select("event_id", "dst_ip", "n", "syn", "ack", (F.col("syn") / (F.col("ack") + 1)).alias("syn_ack_ratio"), entropy_of(F.col("n"), F.col("spread").cast("double")).alias("src_entropy"))


def src_sliding_features(flows: DataFrame, window_us: int) -> DataFrame:
    """For each event, its source over the trailing window, both ends included; events without a source have no row."""
    found = S.trailing(flows, "src_ip", window_us, {"syn": F.col("syn")}, {"dst_ports": ("dst_port", S.is_there), "dst_ips": ("dst_ip", S.is_there)})
    rows = S.at_events(flows, "src_ip", found)
    return rows.select("event_id", "src_ip", "n", "dst_ports", "dst_ips", "syn", (F.col("syn") / F.col("n")).alias("syn_ratio"))


def sample_snapshots(snapshots: DataFrame, order: list[str], key: str, every: int = 5) -> DataFrame:
    """Every ``every``-th row of each key, in order, as training rows."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return snapshots.withColumn("_place", place).where(F.col("_place") % every == 0).drop("_place")


def most_recent_keys(flows: DataFrame, key: str, cap: int) -> DataFrame:
    """The ``cap`` keys seen last, with their last time and the number of keys beyond the cap."""
    last = flows.groupBy(F.col(key).alias("key")).agg(F.max("ts_us").alias("last_us"))
    total = last.agg(F.count("*").alias("keys"))
    return last.orderBy(F.desc("last_us"), "key").limit(cap).crossJoin(F.broadcast(total)).select("key", "last_us", F.greatest(F.lit(0).cast("long"), F.col("keys") - cap).alias("evicted"))


def count_history(rows: DataFrame, window_us: int, category: str, n: int = 12) -> DataFrame:
    """Counts by window and category, with the smallest and largest of the last ``n`` and the place between them."""
    counts = rows.groupBy(window_start(window_us), category).agg(F.count("*").alias("n"))
    w = Window.partitionBy(category).orderBy("window_us").rowsBetween(-(n - 1), 0)
    counts = counts.withColumn("low", F.min("n").over(w)).withColumn("high", F.max("n").over(w))
    return counts.withColumn("scaled", F.when(F.col("high") > F.col("low"), (F.col("n") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0))).otherwise(0.0))
