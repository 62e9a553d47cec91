"""Whole-table plans: ingestion, the driver's tables and the registered queries."""

from ledgerloom.plans import scalar_queries, store_queries, table_queries
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "scalar_queries", "store_queries", "table_queries"]
