"""All queries over the reference operators, with the DuckDB statement of each that SQL can express."""

from __future__ import annotations

from .plans import algebra, data, decompositions, geometry, models, signals, statistics, storage, training
from .plans.base import ORACLE_SQL, QUERIES

flagship = decompositions.pod_modes

__all__ = ["ORACLE_SQL", "QUERIES", "algebra", "data", "decompositions", "flagship", "geometry", "models", "signals", "statistics", "storage", "training"]
