"""Columns that merely pass through an operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, functions as F


def hidden_pass(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on ``docs`` with every column whose name starts with an underscore, as its own working columns do, taken
    through in one struct and put back where it stood."""

    @wraps(run)
    def apply(docs: DataFrame, *args, **named) -> DataFrame:
        hidden = [c for c in docs.columns if c.startswith("_")]
        if not hidden:
            return run(docs, *args, **named)
        carrier = "passing"
        while carrier in [c.lower() for c in docs.columns]:
            carrier += "x"
        plain = [c for c in docs.columns if c not in hidden]
        out = run(docs.select(*[F.col(f"`{c}`") for c in plain], F.struct(*[F.col(f"`{c}`") for c in hidden]).alias(carrier)), *args, **named)
        more = [c for c in out.columns if c not in docs.columns and c != carrier]
        gone = {c for c in plain if c not in out.columns}
        own = [F.col(carrier).getField(c).alias(c) if c in hidden else F.col(f"`{c}`") for c in docs.columns if c not in gone and c not in more]
        return out.select(*own, *[F.col(f"`{c}`") for c in more])

    return apply
