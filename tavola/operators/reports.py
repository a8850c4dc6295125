"""Aggregate reports over orders, items, dishes, staff and stock.

Facts are aggregated by key before they meet a name table, so a join to a
dimension moves one row per key instead of one row per fact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tavola.functions.predicates import SOLD, equals, fill_zero, moment, sold, weekday, where_all


def _named(df: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    return df.join(names.select(F.col("id").alias(key), F.col("name").alias(out)), key)


def _sold_items(items: DataFrame, orders: DataFrame, states: Iterable[str] | None, *columns: str) -> DataFrame:
    """Items with columns of their order; the order side is filtered before the join."""
    kept = where_all(orders, sold(states=states)).select(F.col("id").alias("order_id"), *columns)
    return items.join(kept, "order_id")


def _place(dishes: DataFrame, *columns: str) -> DataFrame:
    return dishes.select(F.col("id").alias("dish_id"), *columns)


# Orders ------------------------------------------------------------------------------------


def orders_per_location(orders: DataFrame, restaurant_id: int | None = None) -> DataFrame:
    return (
        where_all(orders, equals("restaurant_id", restaurant_id))
        .groupBy("restaurant_id")
        .agg(F.count(F.lit(1)).alias("orders_count"), F.sum("total_amount").alias("total_amount"))
    )


def orders_by_status(orders: DataFrame, restaurant_id: int | None = None) -> DataFrame:
    return (
        where_all(orders, equals("restaurant_id", restaurant_id))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy("status")
    )


def location_summary(
    restaurants: DataFrame,
    orders: DataFrame,
    batches: DataFrame,
    restaurant_id: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """Orders and stock per location, each side aggregated before the join.

    `compat` multiplies each sum by the row count of the other side, as joining
    orders to batches row by row does.
    """
    by_orders = (
        where_all(orders, equals("restaurant_id", restaurant_id))
        .groupBy("restaurant_id")
        .agg(F.count("id").alias("orders_count"), F.sum("total_amount").alias("orders_sum"))
    )
    by_stock = (
        where_all(batches, equals("restaurant_id", restaurant_id))
        .groupBy("restaurant_id")
        .agg(F.count("id").alias("stocks_count"), F.sum("qty").alias("stocks_qty"))
    )
    base = where_all(restaurants, equals("id", restaurant_id)).select(
        F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name")
    )
    out = base.join(by_orders, "restaurant_id", "left").join(by_stock, "restaurant_id", "left")
    orders_sum, stocks_qty = F.col("orders_sum"), F.col("stocks_qty")
    if compat:
        orders_sum = orders_sum * F.greatest(fill_zero(F.col("stocks_count")), F.lit(1))
        stocks_qty = stocks_qty * F.greatest(fill_zero(F.col("orders_count")), F.lit(1))
    return out.select(
        "restaurant_id",
        "restaurant_name",
        fill_zero(F.col("orders_count")).alias("orders_count"),
        fill_zero(orders_sum).alias("orders_sum"),
        fill_zero(F.col("stocks_count")).alias("stocks_count"),
        fill_zero(stocks_qty).alias("stocks_qty"),
    ).orderBy("restaurant_id")


def hourly_load(
    orders: DataFrame,
    restaurants: DataFrame,
    states: Iterable[str] | None = SOLD,
    hours: tuple[int, int] | None = None,
    split: bool = True,
) -> DataFrame:
    """Orders per location and hour of day, or per location when `split` is off.

    `hours` keeps an inclusive band of hours.
    """
    hour = F.hour("order_time")
    band = None if hours is None else hour.between(*hours)
    keys = ["restaurant_id", hour.alias("hour_of_day")] if split else ["restaurant_id"]
    counted = (
        where_all(orders, sold(states=states), band)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("order_count"))
    )
    named = _named(counted, restaurants, "restaurant_id", "restaurant")
    names = ["restaurant", "hour_of_day"] if split else ["restaurant"]
    return named.groupBy(*names).agg(F.sum("order_count").alias("order_count"))


def busiest_hour(items: DataFrame, orders: DataFrame, states: Iterable[str] | None = SOLD) -> DataFrame:
    """The hour of day with most dishes; the earlier hour wins a tie."""
    return (
        _sold_items(items, orders, states, "order_time")
        .groupBy(F.hour("order_time").alias("hour_of_day"))
        .agg(F.sum("qty").alias("total_dishes"))
        .orderBy(F.desc("total_dishes"), F.asc("hour_of_day"))
        .limit(1)
    )


# Dishes ------------------------------------------------------------------------------------


def top_dishes_by_home(items: DataFrame, dishes: DataFrame, n: int = 20) -> DataFrame:
    """Dishes by quantity per (home location, name), any status."""
    per_dish = items.groupBy("dish_id").agg(F.sum("qty").alias("qty"))
    return (
        per_dish.join(_place(dishes, "restaurant_id", "name"), "dish_id")
        .groupBy("restaurant_id", "name")
        .agg(F.sum("qty").alias("total_qty"))
        .orderBy(F.desc("total_qty"), "restaurant_id", "name")
        .limit(n)
    )


def popularity_by_order(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    restaurants: DataFrame,
    states: Iterable[str] | None = None,
) -> DataFrame:
    """Quantity per (location of the order, dish name)."""
    per_dish = (
        _sold_items(items, orders, states, "restaurant_id")
        .groupBy("restaurant_id", "dish_id")
        .agg(F.sum("qty").alias("qty"))
    )
    named = _named(per_dish.join(_place(dishes, F.col("name").alias("dish")), "dish_id"),
                   restaurants, "restaurant_id", "restaurant")
    return named.groupBy("restaurant", "dish").agg(F.sum("qty").alias("total_qty"))


def top_completed_dishes(
    items: DataFrame, orders: DataFrame, dishes: DataFrame, restaurants: DataFrame, n: int = 20
) -> DataFrame:
    return (
        popularity_by_order(items, orders, dishes, restaurants, states=("completed",))
        .withColumnRenamed("total_qty", "total")
        .orderBy(F.desc("total"), "restaurant", "dish")
        .limit(n)
    )


def top_per_location(popularity: DataFrame, n: int = 5) -> DataFrame:
    """The `n` most ordered dishes of each location; ties go by name."""
    rank = W.partitionBy("restaurant").orderBy(F.desc("total_qty"), F.asc("dish"))
    return popularity.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def _by_home(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    states: Iterable[str] | None,
    measure: Column,
    *columns: str,
) -> DataFrame:
    per_dish = _sold_items(items, orders, states).groupBy("dish_id").agg(F.sum(measure).alias("m"))
    return per_dish.join(_place(dishes, "restaurant_id", *columns), "dish_id")


def popularity_by_home(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    restaurants: DataFrame,
    states: Iterable[str] | None = SOLD,
) -> DataFrame:
    """Quantity per (home location of the dish, dish name)."""
    per_dish = _by_home(items, orders, dishes, states, F.col("qty"), "name")
    return (
        _named(per_dish, restaurants, "restaurant_id", "restaurant")
        .groupBy("restaurant", F.col("name").alias("dish"))
        .agg(F.sum("m").alias("total_ordered"))
    )


def never_ordered(dishes: DataFrame, items: DataFrame, restaurants: DataFrame) -> DataFrame:
    ordered = items.select(F.col("dish_id").alias("id")).distinct()
    left = dishes.join(ordered, "id", "left_anti")
    return _named(left, restaurants, "restaurant_id", "restaurant").select(
        "restaurant", F.col("name").alias("dish")
    )


def revenue(qty: str = "qty", price: str = "price_at_order") -> Column:
    return F.col(qty) * F.col(price)


def category_revenue_by_home(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    restaurants: DataFrame,
    states: Iterable[str] | None = SOLD,
) -> DataFrame:
    per_dish = _by_home(items, orders, dishes, states, revenue(), "category")
    return (
        _named(per_dish, restaurants, "restaurant_id", "restaurant")
        .groupBy("restaurant", "category")
        .agg(F.sum("m").alias("category_revenue"))
    )


def category_revenue_by_order(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    restaurants: DataFrame,
    states: Iterable[str] | None = None,
) -> DataFrame:
    per_dish = (
        _sold_items(items, orders, states, "restaurant_id")
        .groupBy("restaurant_id", "dish_id")
        .agg(F.sum(revenue()).alias("m"))
    )
    named = _named(per_dish.join(_place(dishes, "category"), "dish_id"),
                   restaurants, "restaurant_id", "restaurant")
    return named.groupBy("restaurant", "category").agg(F.sum("m").alias("revenue"))


def top_revenue_dishes(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    restaurants: DataFrame,
    n: int = 10,
    states: Iterable[str] | None = SOLD,
) -> DataFrame:
    per_dish = _by_home(items, orders, dishes, states, revenue(), "name")
    return (
        _named(per_dish, restaurants, "restaurant_id", "restaurant")
        .groupBy("restaurant", F.col("name").alias("dish"))
        .agg(F.sum("m").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "restaurant", "dish")
        .limit(n)
    )


# Ingredients -------------------------------------------------------------------------------


def ingredient_usage(
    items: DataFrame,
    recipe: DataFrame,
    ingredients: DataFrame,
    orders: DataFrame | None = None,
    states: Iterable[str] | None = SOLD,
    dishes: DataFrame | None = None,
) -> DataFrame:
    """Quantity used per ingredient name.

    Items are summed per dish first: the recipe then meets one row per dish, not
    one per item. `dishes` keeps a subset of dishes by `id`.
    """
    lines = items if orders is None else _sold_items(items, orders, states)
    per_dish = lines.groupBy("dish_id").agg(F.sum("qty").alias("qty"))
    if dishes is not None:
        per_dish = per_dish.join(dishes.select(F.col("id").alias("dish_id")), "dish_id", "left_semi")
    used = (
        per_dish.join(recipe, "dish_id")
        .groupBy("ingredient_id")
        .agg(F.sum(F.col("qty_required") * F.col("qty")).alias("used"))
    )
    return (
        _named(used, ingredients, "ingredient_id", "ingredient")
        .groupBy("ingredient")
        .agg(F.sum("used").alias("total_used"))
    )


def top_ingredients(usage: DataFrame, n: int = 10) -> DataFrame:
    return usage.orderBy(F.desc("total_used"), "ingredient").limit(n)


def popular_dishes(
    items: DataFrame, orders: DataFrame, n: int = 10, states: Iterable[str] | None = SOLD
) -> DataFrame:
    """Ids of the `n` most ordered dishes; the smaller id wins a tie."""
    return (
        _sold_items(items, orders, states)
        .groupBy(F.col("dish_id").alias("id"))
        .agg(F.sum("qty").alias("qty"))
        .orderBy(F.desc("qty"), "id")
        .limit(n)
    )


# Staff -------------------------------------------------------------------------------------


def _staff(orders: DataFrame, users: DataFrame, employees: DataFrame, measure: Column) -> DataFrame:
    """A measure per account, carried to the employee behind it."""
    per_user = where_all(orders, sold()).groupBy("created_by_user").agg(measure.alias("m"))
    accounts = users.select(F.col("id").alias("created_by_user"), "employee_id")
    names = employees.select(F.col("id").alias("employee_id"), F.col("full_name").alias("employee"))
    return per_user.join(accounts, "created_by_user").join(names, "employee_id")


def orders_per_employee(orders: DataFrame, users: DataFrame, employees: DataFrame) -> DataFrame:
    """Distinct orders per employee.

    An order has one account, so distinct counts per account add up.
    """
    per_user = _staff(orders, users, employees, F.countDistinct("id"))
    return per_user.groupBy("employee").agg(F.sum("m").alias("orders_handled"))


def revenue_per_employee(orders: DataFrame, users: DataFrame, employees: DataFrame) -> DataFrame:
    per_user = _staff(orders, users, employees, F.sum("total_amount"))
    return per_user.groupBy("employee").agg(fill_zero(F.sum("m")).alias("total_revenue"))


def staff_roster(
    employees: DataFrame, users: DataFrame, user_roles: DataFrame, roles: DataFrame
) -> DataFrame:
    """Employees with account, role and location (inner)."""
    return (
        employees.select(F.col("id").alias("employee_id"), "full_name")
        .join(users.select(F.col("id").alias("user_id"), "employee_id", "username"), "employee_id")
        .join(user_roles, "user_id")
        .join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id")
        .select("full_name", "username", "restaurant_id", "role")
    )


def account_roster(
    users: DataFrame, user_roles: DataFrame, roles: DataFrame, restaurants: DataFrame
) -> DataFrame:
    """Accounts with role and the name of their location, if any (left)."""
    places = restaurants.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant"))
    return (
        user_roles.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
        .join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id")
        .join(places, "restaurant_id", "left")
        .select("username", "role", "restaurant")
    )


# Demand ------------------------------------------------------------------------------------


def demand_by_day(
    items: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    restaurants: DataFrame,
    as_of: dt.date,
    days: int = 90,
) -> DataFrame:
    """Daily quantity and distinct orders per dish name, home location and category.

    Names repeat inside a location, so the distinct count is taken over
    (group, order) pairs in two plain aggregations.
    """
    recent = orders.where(F.col("order_time") >= moment(as_of - dt.timedelta(days=days)))
    per_order = (
        _sold_items(items, recent, SOLD, F.to_date("order_time").alias("order_date"))
        .join(
            _place(dishes, "restaurant_id", F.col("name").alias("dish_name"), "category"), "dish_id"
        )
        .groupBy("dish_name", "restaurant_id", "category", "order_date", "order_id")
        .agg(F.sum("qty").alias("qty"))
        .groupBy("dish_name", "restaurant_id", "category", "order_date")
        .agg(F.sum("qty").alias("daily_quantity"), F.count(F.lit(1)).alias("daily_orders"))
    )
    return _named(per_order, restaurants, "restaurant_id", "restaurant_name").drop("restaurant_id")


def daily_demand(items: DataFrame, orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Quantity per dish name and UTC day."""
    per_dish = (
        _sold_items(items, orders, SOLD, F.to_date("order_time").alias("day"))
        .groupBy("dish_id", "day")
        .agg(F.sum("qty").alias("qty"))
    )
    return (
        per_dish.join(_place(dishes, F.col("name").alias("dish")), "dish_id")
        .groupBy("day", "dish")
        .agg(F.sum("qty").alias("qty"))
    )


def demand_by_weekday(items: DataFrame, orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Mean and total quantity and item count per dish name and weekday (Sunday = 0)."""
    per_dish = (
        _sold_items(items, orders, SOLD, weekday("order_time").alias("day_of_week"))
        .groupBy("dish_id", "day_of_week")
        .agg(F.sum("qty").alias("qty"), F.count("qty").alias("n"), F.count(F.lit(1)).alias("rows"))
    )
    return (
        per_dish.join(_place(dishes, F.col("name").alias("dish_name")), "dish_id")
        .groupBy("dish_name", "day_of_week")
        .agg(
            (F.sum("qty") / F.sum("n")).alias("avg_qty_per_order"),
            F.sum("qty").alias("total_qty"),
            F.sum("rows").alias("total_orders"),
        )
    )


def dish_sales(
    items: DataFrame,
    dishes: DataFrame,
    orders: DataFrame | None = None,
    states: Iterable[str] | None = None,
) -> DataFrame:
    """Quantity and revenue per dish with sales, any status unless `states` is given."""
    lines = items if states is None else _sold_items(items, orders, states)
    per_dish = (
        lines.groupBy("dish_id")
        .agg(F.sum("qty").alias("total_qty"), F.sum(revenue()).alias("total_revenue"))
        .where(F.col("total_qty") > 0)
    )
    return per_dish.join(
        _place(dishes, F.col("name").alias("dish_name"), "price"), "dish_id"
    ).select("dish_id", "dish_name", "total_qty", "total_revenue", "price")


def category_sales(items: DataFrame, orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Mean price, quantity and revenue per (name, category) of sold items."""
    per_dish = (
        _sold_items(items, orders, SOLD)
        .groupBy("dish_id")
        .agg(
            F.sum("price_at_order").alias("price_sum"),
            F.count("price_at_order").alias("price_n"),
            F.sum("qty").alias("qty"),
            F.sum(revenue()).alias("rev"),
        )
    )
    return (
        per_dish.join(_place(dishes, "name", "category"), "dish_id")
        .groupBy("name", "category")
        .agg(
            (F.sum("price_sum").cast("double") / F.sum("price_n")).alias("avg_price"),
            F.sum("qty").alias("total_qty"),
            F.sum("rev").alias("revenue"),
        )
        .where(F.col("total_qty") > 0)
    )


def with_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of grand totals and means of the given columns."""
    sums = [F.sum(c).alias(f"{c}_sum") for c in columns]
    means = [(F.sum(F.col(c).cast("decimal(38,4)")).cast("double") / F.count(c)).alias(f"{c}_mean") for c in columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), *sums, *means)


def best_selling(demand: DataFrame) -> DataFrame:
    """The series with the largest total; the first name wins a tie."""
    totals = demand.groupBy("dish").agg(F.sum("qty").alias("total_qty"))
    return totals.orderBy(F.desc("total_qty"), "dish").limit(1)


def label_counts(df: DataFrame, column: str = "label") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


# Stock -------------------------------------------------------------------------------------


def low_stock(batches: DataFrame, ingredients: DataFrame, restaurant_id: int | None = None) -> DataFrame:
    """Batches at or under their threshold, inactive ones included."""
    low = where_all(
        batches, equals("restaurant_id", restaurant_id), F.col("qty") <= F.col("min_threshold")
    )
    return _named(low, ingredients, "ingredient_id", "name").select(
        "restaurant_id", "name", "qty", "min_threshold"
    )


def expiring(
    batches: DataFrame,
    ingredients: DataFrame,
    as_of: dt.date,
    days: int = 7,
    restaurant_id: int | None = None,
) -> DataFrame:
    """Batches that expire up to `days` after `as_of`; past ones are included."""
    last = F.lit(as_of + dt.timedelta(days=days))
    soon = where_all(batches, equals("restaurant_id", restaurant_id), F.col("expiry_date") <= last)
    return _named(soon, ingredients, "ingredient_id", "name").select(
        "restaurant_id", "name", "qty", "expiry_date"
    )
