"""Connected components and look-ups of hot keys, as the operators here use them."""

from tavola.operators.components import components, hot_keys, lookup

__all__ = ["components", "hot_keys", "lookup"]
