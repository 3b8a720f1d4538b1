"""Importing this module registers every query."""

from tallyframe.plans import queries_catalog, queries_load, queries_reconcile, queries_workload  # noqa: F401
from tallyframe.plans.registry import ORACLES, QUERIES  # noqa: F401
