"""Waiting times of locations, and alternatives for locations and dishes.

Alternatives take the best `n + 1` candidates per group once, then drop the
asking row from its own list: groups are never paired with themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tavola.functions.predicates import ACTIVE, fill_zero

# Mean preparation time without dishes, and the longest wait offered.
DEFAULT_PREP = 20
LONGEST_WAIT = 60


def location_eta(restaurants: DataFrame, orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """(id, city_id, name, eta_minutes); NULL means there is room now."""
    active = (
        orders.where(F.col("status").isin(*ACTIVE))
        .groupBy(F.col("restaurant_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("active"))
    )
    prep = dishes.groupBy(F.col("restaurant_id").alias("id")).agg(
        F.round(F.avg(F.col("prep_time_minutes").cast("decimal(12,0)"))).cast("int").alias("prep")
    )
    over = fill_zero(F.col("active")) - F.col("max_concurrent_orders")
    wait = (over + 1) * F.coalesce("prep", F.lit(DEFAULT_PREP))
    return (
        restaurants.join(active, "id", "left")
        .join(prep, "id", "left")
        .select("id", "city_id", "name", F.when(over >= 0, wait).alias("eta_minutes"))
    )


def _best(df: DataFrame, keys: list[str], order: list[Column], n: int, *columns: str) -> DataFrame:
    """The first `n` rows of each group as one array, in order."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    entry = F.struct("_rank", *columns)
    return (
        ranked.where(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_best"))
    )


def _others(own: str, n: int) -> Column:
    """The first `n` of the group's list without the row itself, with their positions."""
    return F.posexplode(F.slice(F.filter("_best", lambda x: x["id"] != F.col(own)), 1, n))


def alternative_locations(etas: DataFrame, n: int = 3) -> DataFrame:
    """Up to `n` other locations of the same city with room or a short wait."""
    wait = F.col("eta_minutes")
    open_ = etas.where(wait.isNull() | (wait < LONGEST_WAIT))
    best = _best(open_, ["city_id"], [F.asc_nulls_first("eta_minutes"), F.asc("id")], n + 1,
                 "id", "name", "eta_minutes")
    asked = etas.select(F.col("id").alias("restaurant_id"), "city_id")
    return asked.join(best, "city_id").select(
        "restaurant_id", _others("restaurant_id", n).alias("pos", "alt")
    ).select(
        "restaurant_id",
        (F.col("pos") + 1).alias("rank"),
        "alt.id",
        "alt.name",
        "alt.eta_minutes",
    )


def others_in_city(restaurants: DataFrame) -> DataFrame:
    """(id, others): how many other locations its city has, where there are any."""
    size = restaurants.groupBy("city_id").agg((F.count(F.lit(1)) - 1).alias("others"))
    return restaurants.join(size.where(F.col("others") > 0), "city_id").select("id", "others")


def alternative_dishes(dishes: DataFrame, asked: DataFrame | None = None, n: int = 5) -> DataFrame:
    """Up to `n` available dishes of the same location and category, by id.

    A dish without a category has none. `asked` is the set of dishes to answer
    for, all of them when not given.
    """
    keys = ["restaurant_id", "category"]
    best = _best(dishes.where("is_available AND category IS NOT NULL"), keys, [F.asc("id")], n + 1, "id", "name")
    wanted = (dishes if asked is None else asked).select(
        F.col("id").alias("for_id"), F.col("name").alias("for_name"), *keys
    )
    return wanted.join(best, keys).select(
        "for_id", "for_name", "restaurant_id", _others("for_id", n).alias("pos", "alt")
    ).select(
        "for_id",
        "for_name",
        "restaurant_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("alt.id").alias("dish_id"),
        F.col("alt.name").alias("name"),
        F.lit(1.0).alias("similarity_score"),
    )


def alternatives_for_unavailable(dishes: DataFrame, restaurants: DataFrame, n: int = 3) -> DataFrame:
    """Names of up to `n` alternatives for every dish that is not available."""
    places = restaurants.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant"))
    found = alternative_dishes(dishes, dishes.where(~F.col("is_available")), n)
    return found.join(places, "restaurant_id").select(
        F.col("for_name").alias("unavailable_dish"), "restaurant", F.col("name").alias("alternative_dish")
    )
