"""All registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from tabulae.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
