"""Semi-joins that leave most rows where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the filter that is broadcast: 2^20 words of 64 at most, 16 MB, whatever the number of keys.
FILTER_BITS = 26


def _marked(rows: DataFrame, keys: DataFrame, of_rows: Column) -> DataFrame:
    """``rows`` with ``_row_key`` and ``_near``: whether a fixed-size bitmap of the hashed ``keys`` (_key) has it."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    words = keys.select(slot(F.col("_key")).alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_mask"))
    near = rows.withColumn("_row_key", of_rows).withColumn("_slot", slot(F.col("_row_key"))).withColumn("_at", F.shiftright("_slot", 6))
    near = near.join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return near.withColumn("_near", F.expr("coalesce((_mask & shiftleft(1L, cast(_slot & 63 as int))) <> 0, false)"))


def _distinct(keys: DataFrame, of_keys: Column) -> DataFrame:
    return keys.select(of_keys.alias("_key")).where("_key is not null").distinct()


def only_keys(rows: DataFrame, keys: DataFrame, of_rows: Column, of_keys: Column) -> DataFrame:
    """The ``rows`` whose key is among ``keys``: first by a fixed-size bitmap of hashed keys where the rows are, then exactly
    by a join of what passes. With very many keys the bitmap passes everything and the join does all the work."""
    exact = _distinct(keys, of_keys)
    # an inner join, as the optimizer would push a semi-join below the bitmap; the keys are distinct
    return _marked(rows, exact, of_rows).where("_near").join(exact.hint("merge"), F.col("_row_key") == F.col("_key")).select(*rows.columns)


def split_by_keys(rows: DataFrame, keys: DataFrame, of_rows: Column, of_keys: Column) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose key may be among ``keys``, by the bitmap, and those whose key is not; ``rows`` are read for each."""
    marked = _marked(rows, _distinct(keys, of_keys), of_rows)
    return marked.where("_near").select(*rows.columns), marked.where("not _near").select(*rows.columns)
