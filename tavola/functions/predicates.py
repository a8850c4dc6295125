"""Small column helpers shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Order states counted as sold, and as still being worked on.
SOLD = ("completed", "served")
ACTIVE = ("created", "confirmed", "preparing")


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Keep rows for which every given predicate holds; `None` adds nothing."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def sold(column: str = "status", states: Iterable[str] | None = SOLD) -> Column | None:
    """Predicate for the given states, or nothing when `states` is None."""
    return None if states is None else F.col(column).isin(*states)


def moment(value: dt.date | dt.datetime | str) -> Column:
    """Zone-less literal, so that a comparison leaves the scanned column uncast."""
    return F.lit(str(value)).cast("timestamp_ntz")


def word_tokens(column: str | Column) -> Column:
    """Lower-case words of a text: maximal runs of letters and digits."""
    text = F.col(column) if isinstance(column, str) else column
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def has_all_words(column: str | Column, keywords: str) -> Column:
    """True where every word of `keywords` is a word of the text (no stemming)."""
    tokens = word_tokens(column)
    wanted = F.array_distinct(word_tokens(F.lit(keywords)))
    return F.size(F.array_except(wanted, tokens)) == 0


def weekday(column: str | Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(column) - 1


def only(df: DataFrame, value: Column) -> Column:
    """An aggregate over a whole table as a value beside any row, without a join."""
    return df.agg(value.alias("value")).scalar()


def fill_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))
