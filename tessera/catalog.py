"""Query name to DataFrame factory, and to the SQL it is checked against."""

from __future__ import annotations

from tessera.plans import analysis_queries, ranking_queries, relational_queries  # noqa: F401
from tessera.plans.register import COVERS, ORACLE, QUERIES  # noqa: F401
