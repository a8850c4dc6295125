"""Daily demand forecast per series with a bent trend, a weekly and a yearly pattern.

Every series is one least-squares fit on 1, time, hinges at knots, days of the week and
yearly waves. Spark adds up the normal equations: tasks sum the products of their rows by series
and hand on one row for each series they saw, so a series with very many days is
never gathered. Each series' small system is then solved on its own. Hinges and waves are drawn towards
zero by fixed amounts, so a short history gives a line with a weekly pattern.

Defined results: days without a quantity are left out; several rows of a day count each; a series with fewer than two
days has no forecast; a null series is one of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tavola.operators.forecast import HORIZON

# Share of the history that holds knots and their number, waves a year, days of a year.
KNOT_RANGE = 0.8
KNOTS = 5
WAVES = 3
YEAR = 365.25
#: Squares of coefficients are added to the squared errors with these factors.
BEND, WEEK, WAVE = 0.25, 0.5, 0.5
EPOCH = dt.date(1970, 1, 1)
#: Series whose sums a task holds before it hands them on.
HELD = 20_000

PENALTY = np.array([1e-6, 1e-6] + [BEND] * KNOTS + [WEEK] * 7 + [WAVE] * (2 * WAVES))


def design(day: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One row of regressors for each day (days since 1970); time runs from 0 to 1 over the history."""
    at = (day - first) / np.maximum(last - first, 1)
    knots = KNOT_RANGE * np.arange(1, KNOTS + 1) / (KNOTS + 1)
    angle = 2 * np.pi * day[:, None] / YEAR * np.arange(1, WAVES + 1)
    week = (day[:, None] + 3) % 7 == np.arange(7)
    return np.hstack([np.ones((len(day), 1)), at[:, None], np.maximum(at[:, None] - knots, 0), week, np.sin(angle), np.cos(angle)])


def solve(products: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return np.linalg.solve(products + np.diag(PENALTY), targets)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products by series over the rows of a task."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        columns = [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int64()),
            pa.array([k[2] for k in keys], pa.int64()),
            pa.array([held[k].tolist() for k in keys], pa.list_(pa.float64())),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["series", "first", "last", "sums"])

    for batch in batches:
        frame = batch.to_pandas()
        frame["series"] = frame["series"].astype(object).where(frame["series"].notna(), None)
        x = design(*(frame[c].to_numpy(np.float64) for c in ("day", "first", "last")))
        rows = np.hstack([x, frame[["qty"]].to_numpy(np.float64)])
        codes, keys = pd.factorize(pd.MultiIndex.from_frame(frame[["series", "first", "last"]].assign(series=frame["series"].map(lambda s: (s is None, s or "")))))
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(keys) + 1))
        for n, ((none, name), first, last) in enumerate(keys):
            part = rows[order[bounds[n] : bounds[n + 1]]]
            key = (None if none else name, int(first), int(last))
            held[key] = held.get(key, 0) + (part.T @ part).ravel()
        if len(held) >= HELD:
            yield out()
    yield out()


def _ahead(frame: pd.DataFrame, horizon: int) -> pd.DataFrame:
    k = len(PENALTY)
    found = []
    for name, first, last, sums in zip(frame["series"], frame["first"], frame["last"], frame["sums"]):
        whole = np.asarray(sums, np.float64).reshape(k + 1, k + 1)
        days = last + np.arange(1, horizon + 1, dtype=np.float64)
        made = design(days, np.full(horizon, float(first)), np.full(horizon, float(last))) @ solve(whole[:k, :k], whole[:k, k])
        found += [(name, EPOCH + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, made)]
    return pd.DataFrame(found, columns=["series", "day", "yhat"])


def forecast(demand: DataFrame, series: str = "dish", horizon: int = HORIZON) -> DataFrame:
    """(series, day, yhat) for the `horizon` days after each series' last day; `demand` has (series, day, qty)."""
    rows = demand.where("day IS NOT NULL AND qty IS NOT NULL").select(
        F.col(series).cast("string").alias("series"), F.unix_date(F.col("day").cast("date")).cast("long").alias("day"), F.col("qty").cast("double").alias("qty")
    )
    span = rows.groupBy(F.col("series").alias("name")).agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first < last")
    placed = rows.join(span, F.col("series").eqNullSafe(F.col("name"))).select("series", "day", "first", "last", "qty")
    sums = placed.mapInArrow(_sums, "series string, first long, last long, sums array<double>")
    each = sums.select("series", "first", "last", F.posexplode("sums").alias("at", "v"))
    added = each.groupBy("series", "first", "last", "at").agg(F.sum("v").alias("v"))
    whole = added.groupBy("series", "first", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("sums"))
    made = whole.mapInPandas(lambda frames: (_ahead(f, horizon) for f in frames), "series string, day date, yhat double")
    return made.select(F.col("series").cast(demand.schema[series].dataType).alias(series), "day", "yhat")
