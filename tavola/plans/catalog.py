"""Every registered query, gathered from the plan modules."""

from tavola.plans import guard, model, reports, rules, sales, stock, streams  # noqa: F401
from tavola.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
