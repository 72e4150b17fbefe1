"""All queries over the library's own operators."""

from . import aggregates, arrays, files, joins, normalised, projections, rankings, statistics, streams, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
