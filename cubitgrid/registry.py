"""The spatial queries by name, and their equivalents for the comparing engine."""

from __future__ import annotations

from cubitgrid.plans import boundary_queries, spatial_queries

QUERIES = spatial_queries.QUERIES | boundary_queries.QUERIES
ORACLE_SQL = spatial_queries.ORACLE_SQL | boundary_queries.ORACLE_SQL
