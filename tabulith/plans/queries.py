"""All queries of the engine: importing this module registers them."""

from __future__ import annotations

from tabulith.plans import retrieval, salvage  # noqa: F401  they register their queries
from tabulith.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
