"""Trailing windows as sweeps: an event counts from its time until the window has passed, +1 at ``ts_us`` and -1 just after
``ts_us + window``, and what a window holds is a running sum of such changes.

Counts by category (the events of each source at a destination, say) are running sums as well, and a figure that depends on
them - how many categories there are, the sum of c log c - changes only where one of them does. So it is the running sum
of its own changes, and no window's events are ever listed: n events cost n log n, however long the window.

Running sums are taken in two steps, within ranges of time and between a key's ranges, so that a key with most rows is the
work of as many tasks as it has ranges. Sums of c log c are decimals: what is added is taken away exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges of time in the length of a window.
RANGES = 16
EXACT = "decimal(28,15)"


def running_sums(rows: DataFrame, keys: list[str], at: str, columns: list[str], size: int) -> DataFrame:
    """``rows``, one for each of ``keys`` and place ``at``, with the running sums of ``columns`` by ``at`` as sum_<column>.
    ``size`` is the length of the ranges. Null keys have no rows."""
    dealt = rows.withColumn("_range", F.floor(F.col(at) / size))
    order, own = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys, "_range").orderBy(at)
    base = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_in_{c}") for c in columns])
    base = base.select(*keys, "_range", *[(F.sum(f"_in_{c}").over(order) - F.col(f"_in_{c}")).alias(f"_to_{c}") for c in columns])
    return dealt.join(base, [*keys, "_range"]).select(*rows.columns, *[(F.col(f"_to_{c}") + F.sum(c).over(own)).alias(f"sum_{c}") for c in columns])


def c_log_c(count: Column) -> Column:
    """c log2 c, 0 for none."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(0.0).cast(EXACT)


def is_there(count: Column) -> Column:
    return (count > 0).cast("long")


def trailing(events: DataFrame, key: str, window_us: int, sums: dict[str, Column], figures: dict[str, tuple[str, object]]) -> DataFrame:
    """(key, at, n, the ``sums``, the ``figures``) at every time at which something about the key changes, over the trailing
    window with both ends: events, sums of columns, and figures name -> (category column, function of its count)."""
    size = window_us // RANGES + 1
    kinds = sorted({category for category, _ in figures.values()}) or [key]
    start, end = (F.struct(at.alias("at"), F.lit(d).alias("d")) for at, d in ((F.col("ts_us"), 1), (F.col("ts_us") + window_us + 1, -1)))
    category = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds]))
    rows = events.where(F.col(key).isNotNull()).select(key, "ts_us", category.alias("_c"), *[x.cast("long").alias(f"_x_{s}") for s, x in sums.items()])
    rows = rows.select(key, "_c", F.explode(F.array(start, end)).alias("_e"), *[f"_x_{s}" for s in sums])
    value = F.coalesce(F.col("_c.value"), F.lit(""))
    net = rows.groupBy(key, F.col("_c.kind").alias("_kind"), value.alias("_value"), F.col("_c.value").isNull().alias("_null"), F.col("_e.at").alias("at")).agg(
        F.sum("_e.d").alias("d"), *[F.sum(F.coalesce(f"_x_{s}", F.lit(0)) * F.col("_e.d")).alias(f"_x_{s}") for s in sums])
    counted = running_sums(net, [key, "_kind", "_value", "_null"], "at", ["d"], size)
    once = F.col("_kind") == kinds[0]
    change = lambda c, f: F.sum(F.when((F.col("_kind") == c) & ~F.col("_null"), f(F.col("sum_d")) - f(F.col("sum_d") - F.col("d"))).otherwise(0))
    changes = counted.groupBy(key, "at").agg(F.sum(F.when(once, F.col("d")).otherwise(0)).alias("n"), *[F.sum(F.when(once, F.col(f"_x_{s}")).otherwise(0)).alias(s) for s in sums], *[change(*f).alias(name) for name, f in figures.items()])
    names = ["n", *sums, *figures]
    return running_sums(changes, [key], "at", names, size).select(key, "at", *[F.col(f"sum_{c}").alias(c) for c in names])


def at_events(events: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(event_id, key, ts_us, ...) of each event with what ``trailing`` found at its time; events of one time are peers."""
    return events.select("event_id", key, "ts_us").join(found.withColumnRenamed("at", "ts_us"), [key, "ts_us"])
