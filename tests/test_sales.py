"""Clusters and forecasts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavola.operators import clustering, forecast
from tests.conftest import rows


def blobs(spark):
    rng = random.Random(1)
    centres = [(10, 100), (500, 5000), (2000, 900)]
    data = [(i, f"dish {i}", *(float(m + rng.random()) for m in centres[i % 3])) for i in range(60)]
    return spark.createDataFrame(data, "dish_id int, dish_name string, total_qty double, total_revenue double")


def test_clusters_of_separated_data(spark):
    got = clustering.cluster(blobs(spark), ["total_revenue", "total_qty"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], set()).add(r["dish_id"] % 3)
    assert by == {0: {0}, 1: {2}, 2: {1}}


def test_too_few_rows(spark):
    assert clustering.cluster(blobs(spark).limit(2), ["total_revenue"]).isEmpty()


def test_cluster_names(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 9, 9), (1, 9, 9), (2, 1, 30)], "cluster int, total_qty int, total_revenue int")
    assert rows(clustering.cluster_names(df), "cluster", "name") == [(0, "СЛАБЫЕ"), (1, "СРЕДНИЕ"), (2, "СРЕДНИЕ")]
    hits = spark.createDataFrame([(0, 1, 1), (1, 9, 9)], "cluster int, total_qty int, total_revenue int")
    assert rows(clustering.cluster_names(hits), "cluster", "name") == [(0, "СЛАБЫЕ"), (1, "ХИТЫ")]


def test_top_of_cluster(spark):
    df = clustering.cluster(blobs(spark), ["total_revenue", "total_qty"])
    top = clustering.top_of_cluster(df).collect()
    assert len(top) == 9
    best = max(r["total_revenue"] for r in df.collect())
    assert max(r["total_revenue"] for r in top) == best


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert rows(clustering.one_hot(df, "c", ["a", "b"])) == [(0, 0), (0, 1), (1, 0)]


def test_forecast_follows_line_and_weekday(spark):
    start = dt.date(2024, 3, 1)
    data = [("x", start + dt.timedelta(i), 10 + 2 * i + (50 if (start + dt.timedelta(i)).weekday() == 5 else 0)) for i in range(70)]
    df = spark.createDataFrame(data + [("single", start, 4)], "dish string, day date, qty int")
    got = {(r["dish"], r["day"]): r["yhat"] for r in forecast.forecast(df).collect()}
    assert {d for d, _ in got} == {"x"} and len(got) == 7

    x = np.array([(d - forecast.ORIGIN).days for _, d, _ in data], dtype=float)
    y = np.array([q for *_, q in data], dtype=float)
    slope, intercept = np.polyfit(x, y, 1)
    left = y - slope * x - intercept
    for (_, day), yhat in got.items():
        same = [r for r, (_, d, _) in zip(left, data) if d.weekday() == day.weekday()]
        assert yhat == pytest.approx(intercept + slope * (day - forecast.ORIGIN).days + np.mean(same), abs=1e-6)


def test_forecast_without_history_for_a_weekday(spark):
    d = dt.date(2024, 3, 4)
    df = spark.createDataFrame([("x", d, 1), ("x", d + dt.timedelta(1), 3)], "dish string, day date, qty int")
    got = forecast.forecast(df).orderBy("day").collect()
    assert [round(r["yhat"], 6) for r in got] == [5, 7, 9, 11, 13, 15, 17]
    assert got[0]["day"] == d + dt.timedelta(2)
    assert forecast.forecast(df).select(F.countDistinct("day")).first()[0] == 7
