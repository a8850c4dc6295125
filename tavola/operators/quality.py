"""Declared constraints as reports, and the batch forms of guarded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _cities(assignments: DataFrame, restaurants: DataFrame) -> DataFrame:
    return assignments.join(
        restaurants.select(F.col("id").alias("restaurant_id"), "city_id"), "restaurant_id"
    )


def one_city_only(assignments: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Assignments that agree with the city of the employee's first one, by id.

    The first city comes from an aggregation, which is combined before the
    shuffle, so an employee with very many rows is never sorted in one task.
    """
    rows = _cities(assignments, restaurants)
    first = rows.groupBy("employee_id").agg(F.min_by("city_id", "id").alias("_city"))
    return (
        rows.join(first, "employee_id")
        .where(F.col("city_id") == F.col("_city"))
        .select(*assignments.columns)
    )


def many_cities(assignments: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Employees assigned in more than one city."""
    return (
        _cities(assignments, restaurants)
        .groupBy("employee_id")
        .agg(F.count_distinct("city_id").alias("cities"))
        .where(F.col("cities") > 1)
    )


def bad_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows that end before they start; an open end never does."""
    return df.where(F.col(start) > F.col(end))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for rules every row must satisfy, all in one pass.

    As with a CHECK, a row for which the rule is NULL satisfies it.
    """
    counts = df.agg(*[F.count_if(~ok).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values found more than once; a key with a NULL part is never one."""
    return (
        df.na.drop(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def unique_report(checks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(rule, keys, extra_rows) per (name, table, key) check."""
    parts = [
        duplicate_keys(df, keys).agg(
            F.lit(name).alias("rule"),
            F.count(F.lit(1)).alias("keys"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"),
        )
        for name, df, keys in checks
    ]
    return _stack(parts)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """(key, rows) of child keys no parent row has.

    Child rows are counted per key before the join, so a frequent key is one row.
    """
    used = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def reference_report(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(rule, keys, orphan_rows) per (name, child, key, parent, parent key) check."""
    parts = [
        orphans(child, key, parent, parent_key).agg(
            F.lit(name).alias("rule"),
            F.count(F.lit(1)).alias("keys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        )
        for name, child, key, parent, parent_key in checks
    ]
    return _stack(parts)


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def misplaced_tables(orders: DataFrame, tables: DataFrame) -> DataFrame:
    """Orders seated at a table of another location."""
    seats = tables.select(F.col("id").alias("table_id"), F.col("restaurant_id").alias("table_restaurant_id"))
    return orders.join(seats, "table_id").where(F.col("restaurant_id") != F.col("table_restaurant_id"))


# Writes ------------------------------------------------------------------------------------


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` plus the incoming rows with a new key, one per key.

    Of several new rows with one key the smallest is kept, so that a repeated run
    gives the same table.
    """
    rest = [c for c in existing.columns if c not in keys]
    one = (
        incoming.groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        if rest
        else incoming.select(*keys).distinct()
    )
    new = one.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def ingest_orders(incoming: DataFrame, tables: DataFrame) -> DataFrame:
    """Incoming orders with the table number resolved at their location and defaults set."""
    seats = tables.select("restaurant_id", "table_number", F.col("id").alias("table_id"))
    return incoming.join(seats, ["restaurant_id", "table_number"], "left").select(
        "id",
        "restaurant_id",
        "table_id",
        F.coalesce(F.nullif("status", F.lit("")), F.lit("created")).alias("status"),
        F.coalesce(F.col("total").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")).alias("total_amount"),
    )


def ingest_items(incoming: DataFrame) -> DataFrame:
    """Typed item rows from text fields; a field that is no number becomes NULL."""
    return incoming.select(
        F.col("order_id").try_cast("bigint").alias("order_id"),
        F.col("dish_id").try_cast("bigint").alias("dish_id"),
        F.col("qty").try_cast("int").alias("qty"),
        F.col("price").try_cast("decimal(12,2)").alias("price_at_order"),
    )


def set_by_name(df: DataFrame, name: str, column: str, values: dict[str, object]) -> DataFrame:
    """`column` replaced for the named rows; a handful of constants needs no join."""
    new = F.lit(None)
    for key, value in values.items():
        new = F.when(F.col(name) == key, F.lit(value)).otherwise(new)
    return df.withColumn(column, F.coalesce(new, F.col(column)))


def assign_by_name(people: DataFrame, name: str, groups: dict[int, list[str]]) -> DataFrame:
    """(employee_id, restaurant_id) for people listed by name per location."""
    place = F.lit(None).cast("int")
    for restaurant_id, names in groups.items():
        place = F.when(F.col(name).isin(names), F.lit(restaurant_id)).otherwise(place)
    return people.select(F.col("id").alias("employee_id"), place.alias("restaurant_id")).where(
        F.col("restaurant_id").isNotNull()
    )


def roles_by_prefix(
    users: DataFrame, assignments: DataFrame, roles: DataFrame, prefixes: list[str]
) -> DataFrame:
    """(user_id, role_id, restaurant_id) from user names that start with a role's name."""
    named = roles.where(F.col("name").isin(prefixes)).select(F.col("id").alias("role_id"), "name")
    prefix = F.coalesce(*[F.when(F.startswith("username", F.lit(p)), p) for p in prefixes])
    return (
        users.select(F.col("id").alias("user_id"), "employee_id", prefix.alias("name"))
        .where(F.col("name").isNotNull())
        .join(named, "name")
        .join(assignments.select("employee_id", "restaurant_id"), "employee_id")
        .select("user_id", "role_id", "restaurant_id")
    )


def parse_rows(df: DataFrame, column: str, schema: T.StructType | str, allowed: list[str]) -> DataFrame:
    """JSON objects as typed columns, with the keys that are no column of the table.

    `is_object` is false for text that is not a JSON object.
    """
    keys = F.json_object_keys(column)
    known = F.array(*[F.lit(a) for a in allowed])
    others = [c for c in df.columns if c != column]
    return df.select(
        *others,
        F.from_json(column, schema).alias("_row"),
        F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), known)).alias("unknown_keys"),
        keys.isNotNull().alias("is_object"),
    ).select(*others, "_row.*", "unknown_keys", "is_object")
