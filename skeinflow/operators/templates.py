"""Data of an exporter with the template in force: an as-of join on the templates' intervals of validity.

Templates are few and repeat what they said, so they become intervals first: a template is in force from its ``seq`` until
the next *different* one of its (source_id, template_id). Data that came before the first one (orphans) take that one.

A few intervals are broadcast and the data stay where they are. Many are dealt out with the data by ranges of ``seq``: what
is in force at the start of a range is carried into it, so that an exporter's records are as many tasks' work as they have
ranges, and no task orders more than one range of one template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.stages import settle

KEYS = ["source_id", "template_id"]
#: Intervals up to so many in all, and for one template, are broadcast.
BROADCAST_INTERVALS = 20_000
INTERVALS_OF_ONE = 64
#: Arrivals in a range.
RANGE = 1 << 16


def template_intervals(templates: DataFrame) -> DataFrame:
    """(source_id, template_id, from_seq, until_seq, is_first, fields): when each template is in force; ``until_seq`` is null
    for the last one. Templates without fields are none; of several that came at one ``seq`` the largest counts."""
    own = Window.partitionBy(*KEYS).orderBy("seq")
    one = templates.where("fields is not null").groupBy(*KEYS, "seq").agg(F.max("fields").alias("fields"))
    changed = one.withColumn("_was", F.lag("fields").over(own)).where("_was is null or _was <> fields")
    return changed.select(*KEYS, F.col("seq").alias("from_seq"), F.lead("seq").over(own).alias("until_seq"), (F.row_number().over(own) == 1).alias("is_first"), "fields")


def _resolution(fields: str, before) -> list:
    how = F.when(F.col(fields).isNull(), "none").when(before, "before").otherwise("after")
    return [F.col(fields).alias("fields"), how.alias("resolution")]


def _by_broadcast(data: DataFrame, intervals: DataFrame, columns: list[str]) -> DataFrame:
    marks = F.broadcast(intervals.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "from_seq", "until_seq", "is_first", F.col("fields").alias("_fields")))
    inside = F.col("_row.seq").isNotNull() & (F.col("is_first") | (F.col("_row.seq") >= F.col("from_seq"))) & (F.col("until_seq").isNull() | (F.col("_row.seq") < F.col("until_seq")))
    same = (F.col("_row.source_id") == F.col("_source_id")) & (F.col("_row.template_id") == F.col("_template_id"))
    joined = data.select(F.struct("*").alias("_row")).join(marks, same & inside, "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in columns], *_resolution("_fields", F.col("_row.seq") >= F.col("from_seq")))


def _by_ranges(data: DataFrame, intervals: DataFrame, columns: list[str], size: int) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / size)
    mark = F.struct(F.col("from_seq").alias("seq"), "fields")
    starts = intervals.select(*KEYS, at("from_seq").alias("_range"), mark.alias("_mark"), "is_first")
    last = starts.groupBy(*KEYS, "_range").agg(F.max_by("_mark", "_mark.seq").alias("_last"), F.max_by("_mark", F.when(F.col("is_first"), 1)).alias("_first"))
    places = data.select(*KEYS, at("seq").alias("_range")).distinct()
    whole = Window.partitionBy(*KEYS)
    order = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range that has data or templates: what was in force before it, and the first template of all
    carried = places.join(last, [*KEYS, "_range"], "full_outer").select(*KEYS, "_range", F.last("_last", True).over(order).alias("_mark"), F.max("_first").over(whole).alias("_first"))
    kind = data.select(F.struct("*").alias("_row")).schema["_row"].dataType
    nothing, no_mark = F.lit(None).cast(kind), F.lit(None).cast(intervals.select(mark.alias("m")).schema["m"].dataType)
    rows = data.select(*KEYS, at("seq").alias("_range"), F.struct(F.lit(2).alias("s"), F.col("seq").alias("q")).alias("_place"), F.struct("*").alias("_row"), no_mark.alias("_mark"), no_mark.alias("_first"))
    marks = starts.select(*KEYS, "_range", F.struct(F.lit(1).alias("s"), F.col("_mark.seq").alias("q")).alias("_place"), nothing.alias("_row"), "_mark", no_mark.alias("_first"))
    heads = carried.select(*KEYS, "_range", F.struct(F.lit(0).alias("s"), F.lit(None).cast("long").alias("q")).alias("_place"), nothing.alias("_row"), "_mark", "_first")
    own = Window.partitionBy(*KEYS, "_range").orderBy(F.asc_nulls_first("_place.q"), "_place.s").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).unionByName(heads).withColumn("_before", F.last("_mark", True).over(own)).withColumn("_after", F.last("_first", True).over(own))
    found = both.where("_place.s = 2").withColumn("_fields", F.coalesce("_before.fields", "_after.fields"))
    return found.select(*[F.col("_row")[c].alias(c) for c in columns], *_resolution("_fields", F.col("_before").isNotNull()))


def template_join(data: DataFrame, templates: DataFrame, broadcast: bool | None = None, size: int = RANGE) -> DataFrame:
    """``data`` (source_id, template_id, seq, ...) with the fields of its template: the newest at or before ``seq``, else the
    first one after it; ``resolution`` says before, after or none (then ``fields`` is null).

    ``broadcast`` is decided by the number of intervals unless it is told. A null source_id, template_id or seq has no
    template. Other columns of ``data`` pass through, whatever their names; ``fields`` and ``resolution`` give way."""
    data = data.drop("fields", "resolution")
    intervals = settle(template_intervals(templates), "intervals")
    if broadcast is None:
        sizes = intervals.groupBy(*KEYS).count().agg(F.sum("count").alias("all"), F.max("count").alias("one")).first()
        broadcast = (sizes["all"] or 0) <= BROADCAST_INTERVALS and (sizes["one"] or 0) <= INTERVALS_OF_ONE
    if broadcast:
        return _by_broadcast(data, intervals, data.columns)
    known = data.where("source_id is not null and template_id is not null and seq is not null")
    other = data.where("source_id is null or template_id is null or seq is null")
    lost = other.select("*", F.lit(None).cast(templates.schema["fields"].dataType).alias("fields"), F.lit("none").alias("resolution"))
    return _by_ranges(known, intervals, data.columns, size).unionByName(lost)


def orphan_counts(joined: DataFrame) -> DataFrame:
    """(source_id, template_id, flowsets, orphans, unresolved) of ``template_join``: data flowsets, those that came before
    their template, and those that never got one."""
    of = lambda r: F.count_if(F.col("resolution") == r)
    return joined.groupBy(*KEYS).agg(F.count("*").alias("flowsets"), (of("after") + of("none")).alias("orphans"), of("none").alias("unresolved"))
