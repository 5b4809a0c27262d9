"""Registered queries: the operators on the driver's tables, with SQL to check them."""

from __future__ import annotations

from cohortry.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates, documents, features, graph, joins, models, sources, splits, validation,
)
from cohortry.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
