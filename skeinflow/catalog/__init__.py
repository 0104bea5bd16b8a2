"""All queries of the reference operators: ``QUERIES`` by name, and ``ORACLE_SQL``, the same for DuckDB."""

from .registry import ORACLE_SQL, QUERIES
from . import alerts, detect, evaluate, models, scalars, sessions, sources, streams, windows  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
