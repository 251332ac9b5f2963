"""All queries of the store, and their oracles."""

from __future__ import annotations

from factloom.plans import catalog, writing  # noqa: F401  importing it registers its queries

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
