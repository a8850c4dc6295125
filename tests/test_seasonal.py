"""The seasonal forecast against numpy, and against the plain line on held-out weeks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavola.operators import forecast, seasonal

SCHEMA = "dish string, day date, qty int"
START = dt.date(2023, 1, 2)


def history(name, days, seed, noise=3.0):
    """Demand with a bend in its trend, a weekly and a yearly pattern."""
    rng = np.random.default_rng(seed)
    t = np.arange(days)
    y = 60 + 0.05 * t + np.maximum(t - days * 0.5, 0) * 0.2 + 12 * np.isin(t % 7, (5, 6)) + 10 * np.sin(2 * np.pi * t / 365.25)
    return [(name, START + dt.timedelta(days=int(i)), int(max(v, 0))) for i, v in zip(t, y + rng.normal(0, noise, days))]


def by_hand(rows):
    day = np.array([(r[1] - seasonal.EPOCH).days for r in rows], float)
    first, last = np.full(len(day), day.min()), np.full(len(day), day.max())
    x, y = seasonal.design(day, first, last), np.array([r[2] for r in rows], float)
    # Penalties as further rows of a plain least-squares problem.
    full = np.vstack([x, np.diag(np.sqrt(seasonal.PENALTY))])
    beta = np.linalg.lstsq(full, np.append(y, np.zeros(len(seasonal.PENALTY))), rcond=None)[0]
    ahead = day.max() + np.arange(1, 8)
    return seasonal.design(ahead, first[:7], last[:7]) @ beta


def test_forecast_equals_least_squares(spark, monkeypatch):
    monkeypatch.setattr(seasonal, "HELD", 2)
    made = {n: history(n, d, i) for i, (n, d) in enumerate([("a", 500), ("b", 40), ("c", 8), ("d", 900)])}
    rows = [r for v in made.values() for r in v] + [("one", START, 3), (None, START, 1), (None, START + dt.timedelta(days=3), 5), ("a", None, 1), ("b", START, None)]
    got = seasonal.forecast(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (str(r["dish"]), r["day"])):
        found.setdefault(r["dish"], []).append(r["yhat"])
    assert set(found) == {"a", "b", "c", "d", None} and all(len(v) == 7 for v in found.values())
    for name, part in made.items():
        assert np.allclose(found[name], by_hand(part), atol=1e-4)
    assert max(r["day"] for r in got if r["dish"] == "a") == made["a"][-1][1] + dt.timedelta(days=7)
    assert seasonal.forecast(spark.createDataFrame([], SCHEMA)).count() == 0


def test_beats_the_line_on_held_out_weeks(spark):
    rows = [r for i in range(6) for r in history(f"s{i}", 700 + 20 * i, i)]
    df = spark.createDataFrame(rows, SCHEMA)
    last = df.groupBy("dish").agg(F.max("day").alias("last"))
    placed = df.join(last, "dish")
    known = placed.where(F.col("day") <= F.date_sub("last", 7)).drop("last")
    held = placed.where(F.col("day") > F.date_sub("last", 7)).drop("last")

    def error(made):
        return made.join(held, ["dish", "day"]).agg(F.avg(F.abs(F.col("yhat") - F.col("qty")))).first()[0]

    bent, line = error(seasonal.forecast(known)), error(forecast.forecast(known))
    assert bent < 4 and bent < 0.6 * line, (bent, line)


@pytest.mark.parametrize("n", [2, 3])
def test_short_histories(spark, n):
    got = seasonal.forecast(spark.createDataFrame([("a", START + dt.timedelta(days=i), 10) for i in range(n)], SCHEMA)).collect()
    assert len(got) == 7 and all(np.isfinite(r["yhat"]) and 0 <= r["yhat"] < 25 for r in got)
