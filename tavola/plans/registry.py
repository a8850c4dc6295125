"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tavola.functions.formatting import plain_types
from tavola.plans.views import VIEWS
from tavola.sources.chain import Chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\bd_\w+")


def with_views(sql: str) -> str:
    """Put the definitions of the `d_*` views a statement uses in front of it."""
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in _NAME.findall(text):
            if name not in ordered and name in VIEWS:
                add(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    add(sql)
    if not ordered:
        return sql
    defs = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {defs},\n{body[5:]}"
    return f"WITH {defs}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function from a chain to a DataFrame, with its SQL where one exists."""

    def register(fn: Callable[[Chain], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain_types(fn(Chain(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
