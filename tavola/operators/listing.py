"""Row listings: browse, menu, orders, stock, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tavola.functions.predicates import equals, has_all_words, where_all
from tavola.functions.stemming import has_all_stems

# Page sizes, the defaults of the listings. A larger limit is honoured, None means all rows.
MENU_LIMIT = 200
ORDERS_LIMIT = 300
BROWSE_LIMIT = 100


def first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(max(1, limit))


def browse(df: DataFrame, where: Column | str | None = None, limit: int | None = BROWSE_LIMIT) -> DataFrame:
    """First `limit` rows by the first column, ties broken by the rest."""
    if isinstance(where, str):
        where = F.expr(where) if where.strip() else None
    sortable = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
    ]
    return first(where_all(df, where).orderBy(*[F.asc_nulls_last(c) for c in sortable]), limit)


def menu(
    dishes: DataFrame,
    restaurant_id: int | None = None,
    category: str | None = None,
    is_available: bool | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    keyword: str | None = None,
    words: str | None = None,
    limit: int | None = MENU_LIMIT,
    stems: str | None = None,
) -> DataFrame:
    """Dishes matching every given filter, by location and name.

    `keyword` is a substring of the name in any case (its `%` and `_` are plain
    characters); `words` asks for each of its words among the words of the name, `stems`
    for a form of each.
    """
    price = F.col("price")
    kept = where_all(
        dishes,
        equals("restaurant_id", restaurant_id),
        None if not category else F.lower("category") == F.lower(F.lit(category)),
        equals("is_available", is_available),
        None if price_min is None else price >= F.lit(price_min),
        None if price_max is None else price <= F.lit(price_max),
        None if not keyword else F.contains(F.lower("name"), F.lower(F.lit(keyword))),
        None if not words else has_all_words("name", words),
        None if not stems else has_all_stems("name", stems),
    )
    columns = ("id", "restaurant_id", "name", "category", "price", "prep_time_minutes", "is_available")
    return first(kept.select(*columns).orderBy("restaurant_id", "name", "id"), limit)


def orders_list(
    orders: DataFrame,
    tables: DataFrame,
    restaurant_id: int | None = None,
    status: str | None = None,
    limit: int | None = ORDERS_LIMIT,
) -> DataFrame:
    """Newest orders with their dining table's number.

    A left join to a unique key keeps one row per order, so the newest rows are
    picked first and only those are joined.
    """
    newest = [F.desc_nulls_first("order_time"), F.asc("id")]
    kept = where_all(orders, equals("restaurant_id", restaurant_id), equals("status", status))
    top = first(kept.orderBy(*newest), limit)
    numbers = tables.select(F.col("id").alias("table_id"), "table_number")
    return top.join(numbers, "table_id", "left").select(
        "id",
        "restaurant_id",
        "table_number",
        "guest_name",
        "status",
        F.col("order_time").alias("created_at"),
        "total_amount",
    )


def stock_list(batches: DataFrame, ingredients: DataFrame, restaurant_id: int | None = None) -> DataFrame:
    """Batches with ingredient names, by location and name."""
    names = ingredients.select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient_name"))
    return (
        where_all(batches, equals("restaurant_id", restaurant_id))
        .join(names, "ingredient_id")
        .select(
            "id", "restaurant_id", "ingredient_id", "ingredient_name", "qty", "expiry_date", "min_threshold"
        )
        .orderBy("restaurant_id", "ingredient_name")
    )


def request_list(
    requests: DataFrame,
    ingredients: DataFrame,
    restaurant_id: int | None = None,
    ingredient_id: int | None = None,
) -> DataFrame:
    """Purchase requests with ingredient names, newest first."""
    names = ingredients.select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient_name"))
    return (
        where_all(
            requests, equals("restaurant_id", restaurant_id), equals("ingredient_id", ingredient_id)
        )
        .join(names, "ingredient_id")
        .select("id", "restaurant_id", "ingredient_name", "qty", "status", "created_at")
        .orderBy(F.desc_nulls_first("created_at"))
    )


def unavailable_dishes(dishes: DataFrame, restaurants: DataFrame) -> DataFrame:
    places = restaurants.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant"))
    return (
        dishes.where(~F.col("is_available"))
        .join(places, "restaurant_id")
        .select("restaurant", F.col("name").alias("dish"))
        .orderBy("restaurant", "dish")
    )


def public_roles(roles: DataFrame) -> DataFrame:
    return roles.where(F.col("name") != "admin").select("name").orderBy("name")


def search_texts(texts: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose text holds every word of `words`."""
    return texts.where(has_all_words(column, words))
