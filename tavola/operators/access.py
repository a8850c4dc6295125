"""Who sees which rows: the declared policies, grants and report scoping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tavola.functions.predicates import only

# Per table, how much of it each role sees. "own" is the viewer's
# location, "orders" and "assignments" reach the location through a parent row.
# A role that is not listed sees nothing.
_WIDE = {"admin": "all", "analyst": "all"}
POLICIES = {
    "orders": {**_WIDE, "manager": "own", "waiter": "own", "cook": "own"},
    "order_items": {**_WIDE, "manager": "orders", "waiter": "orders", "cook": "orders"},
    "ingredients": _WIDE,
    "ingredient_batches": {**_WIDE, "manager": "own", "cook": "own"},
    "dishes": {**_WIDE, "manager": "own", "cook": "own", "waiter": "own"},
    "purchase_requests": {**_WIDE, "manager": "own", "cook": "own"},
    "inventory_movements": {**_WIDE, "manager": "own", "cook": "own"},
    "reservations": {**_WIDE, "manager": "own", "waiter": "own"},
    "feedbacks": {**_WIDE, "manager": "orders"},
    "employees": {"admin": "all", "manager": "assignments"},
}

# Who may add order items, and to which orders.
ITEM_INSERT = {"admin": "all", "manager": "own", "waiter": "own"}

# Granted verbs. Admin holds every verb on every table, and a
# waiter's update of orders is limited to the status column.
VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE")
GRANTS = {
    "analyst": {
        "SELECT": (
            "cities", "restaurants", "restaurant_tables", "employees",
            "employee_assignments", "dishes", "dish_ingredients", "dish_price_history",
            "orders", "order_items", "ingredients", "ingredient_batches",
            "inventory_movements", "purchase_requests", "suppliers", "reservations",
            "feedbacks", "audit_logs",
        ),
    },
    "manager": {
        verb: (
            "orders", "order_items", "reservations", "purchase_requests",
            "ingredient_batches", "inventory_movements",
        )
        for verb in ("SELECT", "INSERT", "UPDATE")
    },
    "cook": {
        "SELECT": ("orders", "order_items", "dishes", "dish_ingredients", "ingredients", "ingredient_batches"),
        "INSERT": ("purchase_requests",),
    },
    "waiter": {
        "SELECT": ("dishes", "orders", "order_items"),
        "INSERT": ("orders", "order_items"),
        "UPDATE": ("orders",),
    },
}
MODULES = {
    "admin": ("admin", "tables", "query", "inventory", "orders", "menu", "reports", "purchase"),
    "analyst": ("tables", "query", "menu", "reports"),
    "manager": ("tables", "inventory", "orders", "menu", "reports", "purchase"),
    "cook": ("inventory", "menu", "purchase"),
    "waiter": ("orders", "menu"),
}


def row_filter(
    df: DataFrame,
    table: str,
    role: str,
    location: int | None = None,
    orders: DataFrame | None = None,
    assignments: DataFrame | None = None,
) -> DataFrame:
    """Rows of `table` a role at a location sees; tables without a policy are whole."""
    if table not in POLICIES:
        return df
    rule = POLICIES[table].get(role)
    at = F.col("restaurant_id") == F.lit(location)
    if rule == "all":
        return df
    if rule == "own":
        return df.where(at)
    if rule == "orders":
        parents = orders.where(at).select(F.col("id").alias("order_id"))
        return df.join(parents, "order_id", "left_semi")
    if rule == "assignments":
        parents = assignments.where(at).select(F.col("employee_id").alias("id"))
        return df.join(parents, "id", "left_semi")
    return df.where(F.lit(False))


def _extent(rules: dict[str, str], role: Column) -> Column:
    """`all`, `own` or NULL for a role column."""
    out = F.lit(None).cast("string")
    for name, rule in rules.items():
        out = F.when(role == name, "all" if rule == "all" else "own").otherwise(out)
    return out


def visible_counts(df: DataFrame, table: str, viewers: DataFrame) -> DataFrame:
    """(user_id, visible_rows) for every viewer (user_id, role, restaurant_id).

    `df` carries `restaurant_id`; rows are counted per location once and only the
    counts meet the viewers.
    """
    per_place = df.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("own_rows"))
    extent = _extent(POLICIES[table], F.col("role"))
    every = only(per_place, F.sum("own_rows"))
    seen = F.when(extent == "all", every).when(extent == "own", F.col("own_rows"))
    return viewers.join(per_place, "restaurant_id", "left").select(
        "user_id", F.coalesce(seen, F.lit(0)).alias("visible_rows")
    )


def via_orders(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Child rows with the location of their order."""
    return df.join(orders.select(F.col("id").alias("order_id"), "restaurant_id"), "order_id")


def check_item_inserts(proposals: DataFrame, orders: DataFrame, viewers: DataFrame) -> DataFrame:
    """Proposed items (user_id, order_id, …) with `accepted` by the insert policies.

    An unknown user or order is refused.
    """
    place = orders.select(F.col("id").alias("order_id"), F.col("restaurant_id").alias("_place"))
    who = viewers.select("user_id", F.col("role").alias("_role"), F.col("restaurant_id").alias("_own"))
    extent = _extent(ITEM_INSERT, F.col("_role"))
    known = F.col("_place").isNotNull()
    ok = ((extent == "all") & known) | ((extent == "own") & (F.col("_own") == F.col("_place")))
    return (
        proposals.join(place, "order_id", "left")
        .join(who, "user_id", "left")
        .withColumn("accepted", F.coalesce(ok, F.lit(False)))
        .drop("_place", "_role", "_own")
    )


def grant_rows(tables: list[str]) -> list[tuple[str, str, str, str | None]]:
    """(role, verb, table, only column) of every grant."""
    rows = [("admin", verb, table, None) for verb in VERBS for table in tables]
    for role, verbs in GRANTS.items():
        for verb, names in verbs.items():
            for table in names:
                only = "status" if (role, verb, table) == ("waiter", "UPDATE", "orders") else None
                rows.append((role, verb, table, only))
    return rows


def grant_matrix(spark: SparkSession, tables: list[str]) -> DataFrame:
    return spark.createDataFrame(
        grant_rows(tables), "role string, verb string, table_name string, only_column string"
    )


def module_matrix(spark: SparkSession) -> DataFrame:
    rows = [(role, module) for role, names in MODULES.items() for module in names]
    return spark.createDataFrame(rows, "role string, module string")


def grant_report(viewers: DataFrame, matrix: DataFrame) -> DataFrame:
    """Accounts that hold each verb on each table; accounts are counted per role first."""
    per_role = viewers.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_role.join(matrix, "role")
        .groupBy("table_name", "verb")
        .agg(F.sum("n").alias("accounts"))
    )


def primary_roles(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, role, restaurant_id): each user's alphabetically first role."""
    named = user_roles.join(
        roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id"
    )
    return named.groupBy("user_id").agg(
        F.min("role").alias("role"), F.min_by("restaurant_id", "role").alias("restaurant_id")
    )


def scoped(df: DataFrame, role: str | None, location: int | None, column: str = "restaurant_id") -> DataFrame:
    """A report's rows for a viewer: only a non-admin with a location is limited to it."""
    if role != "admin" and location is not None:
        return df.where(F.col(column) == F.lit(location))
    return df


def scoped_counts(df: DataFrame, viewers: DataFrame) -> DataFrame:
    """(user_id, rows_seen) under report scoping, for every viewer."""
    per_place = df.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("own_rows"))
    limited = (F.col("role") != "admin") & F.col("restaurant_id").isNotNull()
    every = F.coalesce(only(per_place, F.sum("own_rows")), F.lit(0))
    seen = F.when(limited, F.coalesce("own_rows", F.lit(0))).otherwise(every)
    return viewers.join(per_place, "restaurant_id", "left").select("user_id", seen.alias("rows_seen"))
