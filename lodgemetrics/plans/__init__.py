"""Registered queries."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=1)
def build_catalog():
    """All queries with their oracle SQL, in operator order."""
    from lodgemetrics.plans import (
        adr_queries, cancel_queries, forecast_queries, kpi_queries, prepare_queries,
        policy_queries, pricing_queries, revpar_queries, stats_queries,
    )
    from lodgemetrics.plans.catalog import Catalog

    catalog = Catalog()
    for area in (prepare_queries, kpi_queries, revpar_queries, cancel_queries, adr_queries,
                 stats_queries, forecast_queries, pricing_queries, policy_queries):
        area.register(catalog)
    return catalog
