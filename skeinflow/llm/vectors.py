"""What the two vector operators share: which vectors take part, batches as matrices, runs of sorted rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def stored(df: DataFrame) -> str:
    """The type in which the components of ``embedding`` are moved: as they are stored, floats as floats. Tasks compute with
    doubles, and float components are exact as doubles."""
    return "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def numbered(df: DataFrame) -> DataFrame:
    """(vec_id long, vector) of the vectors that take part."""
    vector = F.col("embedding").cast(stored(df))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(usable(F.col("vector")))


def matrices(batch: pa.RecordBatch, column: str):
    """For each length of vectors in the batch: (positions, matrix of doubles)."""
    lists = batch.column(column)
    lengths, flat, at = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)].astype(np.float64)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def runs(batches, keys: list[str]):
    """Tables of the rows that agree in ``keys``, from batches sorted by them. Memory: one run and one batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *new.tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held
