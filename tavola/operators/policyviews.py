"""Row policies as views: whatever SQL a user writes over them is filtered.

`define` gives every table with a policy a view `visible_<table>` that reads the session variables
`viewer_role` and `viewer_location`. `SET VAR` changes what all of them show, from the next query on; a
table's rows are reached through views alone, so joins, subqueries and aggregates see the filtered rows too.
Parents are filtered before they meet their children (semi-joins), and a location is pushed into the scan.

An unknown or null role sees nothing; so does a role bound to a location while the location is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tavola.operators.access import POLICIES

ROLE, LOCATION = "viewer_role", "viewer_location"
# How a rule reaches the viewer's location, over the registered base tables.
CONDITIONS = {
    "all": "true",
    "own": f"restaurant_id = {LOCATION}",
    "orders": f"order_id IN (SELECT id FROM base_orders WHERE restaurant_id = {LOCATION})",
    "assignments": f"id IN (SELECT employee_id FROM base_assignments WHERE restaurant_id = {LOCATION})",
}


def view_sql(table: str) -> str:
    """The statement that defines the view of one table: a branch for each rule, of which one role takes one."""
    rules: dict[str, list[str]] = {}
    for role, rule in POLICIES[table].items():
        rules.setdefault(rule, []).append(role)
    branches = [
        f"SELECT * FROM base_{table} WHERE {ROLE} IN ({', '.join(repr(r) for r in roles)}) AND {CONDITIONS[rule]}"
        for rule, roles in rules.items()
    ]
    return f"CREATE OR REPLACE TEMPORARY VIEW visible_{table} AS {' UNION ALL '.join(branches)}"


def define(spark: SparkSession, tables: dict[str, DataFrame], assignments: DataFrame | None = None) -> list[str]:
    """Views of the given tables; returns their names. Needs `orders` where a policy goes through them."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {ROLE} STRING DEFAULT NULL")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {LOCATION} BIGINT DEFAULT NULL")
    for name, df in tables.items():
        df.createOrReplaceTempView(f"base_{name}")
    if assignments is not None:
        assignments.createOrReplaceTempView("base_assignments")
    made = [name for name in tables if name in POLICIES]
    for name in made:
        spark.sql(view_sql(name))
    return [f"visible_{name}" for name in made]


def become(spark: SparkSession, role: str | None, location: int | None = None) -> None:
    """Set whose rows the views show."""
    spark.sql(f"SET VAR {ROLE} = :role", {"role": role})
    spark.sql(f"SET VAR {LOCATION} = CAST(:place AS BIGINT)", {"place": location})
