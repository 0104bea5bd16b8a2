"""A character trigram model of names, and the perplexity it gives to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import leftmost_label

VOCABULARY = "abcdefghijklmnopqrstuvwxyz0123456789-"
FLOOR = 1e-9
SHORT = 50.0


def _grams(label: Column, end: str) -> Column:
    """(ctx, ch) of each character after two before it, with ^^ in front."""
    padded = F.concat(F.lit("^^"), label, F.lit(end))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.struct(F.substring(padded, i, F.lit(2)).alias("ctx"), F.substring(padded, i + 2, F.lit(1)).alias("ch")))


def train_trigram_lm(names: DataFrame, column: str = "domain") -> DataFrame:
    """(ctx, ch, p): Laplace-smoothed chances of each character of the vocabulary, and ``_unk_``, after each context."""
    rows = names.where(F.length(column) > 0).select(F.explode(_grams(F.lower(column), "$")).alias("g")).select("g.*")
    counts = rows.groupBy("ctx", "ch").agg(F.count("*").alias("n"))
    totals = counts.groupBy("ctx").agg((F.sum("n") + len(VOCABULARY)).alias("total"))
    grid = totals.withColumn("ch", F.explode(F.array(*[F.lit(x) for x in VOCABULARY], F.lit("_unk_"))))
    return grid.join(counts, ["ctx", "ch"], "left").select("ctx", "ch", ((F.coalesce("n", F.lit(0)) + 1) / F.col("total")).alias("p"))


def trigram_perplexity(names: DataFrame, model: DataFrame, key: str, column: str = "domain") -> DataFrame:
    """(key, perplexity) of the leftmost labels; those under three characters have 50."""
    labels = names.select(F.col(key), leftmost_label(F.col(column)).alias("label"))
    grams = labels.where(F.length("label") >= 3).select("label").distinct().select("label", F.explode(_grams(F.col("label"), "")).alias("g")).select("label", "g.*")
    known = grams.join(model, ["ctx", "ch"], "left").join(model.where("ch = '_unk_'").select("ctx", F.col("p").alias("other")), "ctx", "left")
    p = F.greatest(F.coalesce("p", "other", F.lit(FLOOR)), F.lit(FLOOR))
    found = known.groupBy("label").agg(F.exp(-F.avg(F.log(p))).alias("perplexity"))
    return labels.join(found, "label", "left").select(key, F.coalesce("perplexity", F.lit(SHORT)).alias("perplexity"))
