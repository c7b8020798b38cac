"""All registered queries and their SQL."""

from riskframe.catalog import changing, checks, governance, parsing, scoring, store, streams, vectors  # noqa: F401  each module registers its queries
from riskframe.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
