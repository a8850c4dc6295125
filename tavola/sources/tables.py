"""Table readers and the declared schemas of the chain's relational store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tavola.functions.predicates import only

# The 21 tables of the store with their column types.
SCHEMAS = {
    "cities": "id int, name string",
    "restaurants": "id int, city_id int, name string, address string, postal_code string, "
    "phone string, capacity int, tables_count int, max_concurrent_orders int, created_at timestamp",
    "restaurant_tables": "id int, restaurant_id int, table_number string, seats int",
    "employees": "id int, full_name string, position string, phone string, email string, "
    "experience_years int, age int, salary decimal(12,2), description string, hired_at date",
    "employee_assignments": "id int, employee_id int, restaurant_id int, "
    "assigned_from timestamp, assigned_to timestamp",
    "app_users": "id string, employee_id int, username string, password_hash string, "
    "created_at timestamp",
    "app_roles": "id int, name string",
    "app_user_roles": "user_id string, role_id int, restaurant_id int",
    "suppliers": "id int, name string, phone string, contact_person string, created_at timestamp",
    "ingredients": "id int, name string, unit string, allergen boolean, created_at timestamp",
    "ingredient_batches": "id int, ingredient_id int, restaurant_id int, supplier_id int, "
    "batch_no string, qty decimal(12,4), unit string, price_per_unit decimal(12,4), "
    "received_at timestamp, expiry_date date, active boolean, min_threshold decimal(12,4)",
    "inventory_movements": "id int, batch_id int, ingredient_id int, restaurant_id int, "
    "change_qty decimal(12,4), reason string, related_order_id int, created_at timestamp",
    "purchase_requests": "id int, restaurant_id int, ingredient_id int, qty decimal(12,4), "
    "status string, created_at timestamp",
    "dishes": "id int, restaurant_id int, name string, category string, price decimal(12,2), "
    "prep_time_minutes int, is_available boolean, created_at timestamp",
    "dish_ingredients": "dish_id int, ingredient_id int, qty_required decimal(12,4)",
    "dish_price_history": "id int, dish_id int, price decimal(12,2), valid_from timestamp, "
    "valid_to timestamp",
    "orders": "id int, restaurant_id int, table_id int, guest_name string, "
    "created_by_user string, completed_by_user string, order_time timestamp, "
    "scheduled_for timestamp, status string, accepted_at timestamp, preparing_at timestamp, "
    "ready_at timestamp, served_at timestamp, completed_at timestamp, cancelled_at timestamp, "
    "total_amount decimal(12,2), is_finalized boolean",
    "order_items": "id int, order_id int, dish_id int, qty int, price_at_order decimal(12,2), "
    "special_requests string",
    "feedbacks": "id int, order_id int, rating int, comment string, created_at timestamp",
    "audit_logs": "id int, user_id string, action_type string, table_name string, "
    "row_data string, created_at timestamp",
    "reservations": "id int, restaurant_id int, table_id int, guest_name string, "
    "reserved_from timestamp, reserved_to timestamp, status string",
}

# Tables never handed out by the export.
SENSITIVE = ("app_users", "app_roles", "app_user_roles", "purchase_requests")


def schema_of(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])


def load_table(spark: SparkSession, folder: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One table of a folder; text formats take the declared schema, parquet its own."""
    reader = spark.read
    if fmt in ("csv", "json"):
        if table in SCHEMAS:
            reader = reader.schema(SCHEMAS[table])
        reader = reader.option("header", True) if fmt == "csv" else reader
    return reader.format(fmt).load(f"{folder}/{table}.{fmt}")


def load_tables(
    spark: SparkSession, folder: str, tables: list[str], fmt: str = "parquet", views: bool = False
) -> dict[str, DataFrame]:
    """Several tables by name, registered as temp views when `views` is set."""
    loaded = {t: load_table(spark, folder, t, fmt) for t in tables}
    if views:
        for name, df in loaded.items():
            df.createOrReplaceTempView(name)
    return loaded


def load_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options
) -> DataFrame:
    """One table over JDBC, read in `parts` ranges of the numeric column `key`."""
    low, high = bounds
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, **options)
        .options(lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        .load()
    )


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, is_nullable, position) of the given tables.

    Spark has no identity columns, so there is no serial flag.
    """
    rows = [
        (name, f.name, f.dataType.simpleString(), f.nullable, i)
        for name, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows,
        "table_name string, column_name string, data_type string, is_nullable boolean, position int",
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, as `<name>` columns."""
    spark = next(iter(tables.values())).sparkSession
    counts = [only(df, F.count(F.lit(1))).alias(name) for name, df in tables.items()]
    return spark.range(1).select(*counts)
