"""Daily demand forecast per series: a line plus a mean weekday effect.

Everything comes from sums per (series, weekday), so one aggregation of the
history is enough and no series is gathered row by row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tavola.functions.predicates import weekday

HORIZON = 7
ORIGIN = dt.date(2000, 1, 1)
WIDE = "decimal(38,0)"


def forecast(demand: DataFrame, series: str = "dish", horizon: int = HORIZON) -> DataFrame:
    """(series, day, yhat) for the `horizon` days after each series' last day.

    `demand` has one row per (series, day) with an integral `qty`. A series with
    fewer than two days has no forecast.
    """
    x = F.date_diff("day", F.lit(ORIGIN)).cast("bigint")
    y = F.col("qty").cast("bigint")
    per_weekday = demand.groupBy(series, weekday("day").alias("_w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"),
        F.sum(x * x).alias("sxx"),
        F.max("day").alias("last_day"),
    )
    lines = (
        per_weekday.groupBy(series)
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")],
            F.max("last_day").alias("last_day"),
            F.map_from_entries(F.collect_list(F.struct("_w", F.struct("n", "sx", "sy")))).alias("_by"),
        )
        .where(F.col("n") >= 2)
    )

    def times(a: str, b: str) -> Column:
        return F.col(a).cast(WIDE) * F.col(b).cast(WIDE)

    slope = (times("n", "sxy") - times("sx", "sy")).cast("double") / (
        times("n", "sxx") - times("sx", "sx")
    ).cast("double")
    lines = lines.withColumn("slope", slope).withColumn(
        "intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    days = lines.select("*", ahead.alias("_step")).withColumn("day", F.date_add("last_day", F.col("_step")))
    own = F.col("_by")[weekday("day")]
    effect = own["sy"] / own["n"] - F.col("slope") * own["sx"] / own["n"] - F.col("intercept")
    at = F.date_diff("day", F.lit(ORIGIN))
    line = F.col("intercept") + F.col("slope") * at
    return days.select(series, "day", (line + F.coalesce(effect, F.lit(0.0))).alias("yhat"))
