"""Queries over the driver's tables; importing the modules registers them."""

from psephos.plans import builds, catalog, checks, dims, electoral, flows, guards, loads, scopes  # noqa: F401
from psephos.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
