"""All queries of the reference's operators, and their SQL, by name."""

from __future__ import annotations

from veraline.plans import accounting, evaluation, records, trust  # noqa: F401  each module registers its queries
from veraline.plans.sql import ORACLE_SQL, QUERIES, TABLES

__all__ = ["ORACLE_SQL", "QUERIES", "TABLES"]
