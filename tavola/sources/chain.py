"""The chain's tables derived from the star-schema tables the engine is run on.

region/nation stand for cities/restaurants, part for dishes, supplier for
ingredients, orders/lineitem for orders and their items, customer for employees
and accounts, and events for the live order log. Column names and types follow
the declared schemas, so operators work the same on the real tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tavola.functions.sqllog import sql_text

LOCATIONS = 25
TABLES_PER_LOCATION = 5
QTY = "decimal(12,4)"
MONEY = "decimal(12,2)"

# How the star schema's codes read in the chain's terms.
ORDER_STATES = {"F": "completed", "P": "served", "O": "created"}
EVENT_STATES = {
    "purchase": "completed",
    "view": "served",
    "click": "created",
    "signup": "preparing",
    "error": "cancelled",
}
SEGMENT_ROLES = {
    "BUILDING": ("admin", 1),
    "MACHINERY": ("manager", 2),
    "FURNITURE": ("cook", 3),
    "AUTOMOBILE": ("waiter", 4),
    "HOUSEHOLD": ("analyst", 5),
}


def _lookup(column: str, mapping: dict) -> Column:
    out = None
    for code, meaning in mapping.items():
        hit = F.col(column) == code
        out = F.when(hit, meaning) if out is None else out.when(hit, meaning)
    return out


def _location(key: str) -> Column:
    return (F.col(key) % LOCATIONS).cast("int")


def _completion() -> list[Column]:
    """Finished orders were completed an hour after they came in, by the user after their creator."""
    done = F.col("o_orderstatus") == "F"
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    return [F.when(done, at).alias("completed_at"), F.when(done, F.col("o_custkey") + 1).alias("completed_by_user")]


class Chain:
    """Lazily defined tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cities(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def restaurants(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_regionkey").alias("city_id"),
            F.col("n_name").alias("name"),
        )

    @cached_property
    def capacities(self) -> DataFrame:
        """Restaurants with an order limit sized by their number of guests."""
        limit = self.raw("customer").groupBy(F.col("c_nationkey").alias("id")).agg(
            F.floor(F.count(F.lit(1)) * 10 / 3).cast("int").alias("max_concurrent_orders")
        )
        return self.restaurants.join(limit, "id", "left").withColumn(
            "max_concurrent_orders", F.coalesce("max_concurrent_orders", F.lit(10))
        )

    @cached_property
    def sites(self) -> DataFrame:
        """Suppliers read as locations, for jobs that should grow with the data."""
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    @cached_property
    def tables(self) -> DataFrame:
        number = F.explode(F.sequence(F.lit(1), F.lit(TABLES_PER_LOCATION)))
        return (
            self.restaurants.select(F.col("id").alias("restaurant_id"), number.alias("n"))
            .select(
                (F.col("restaurant_id") * TABLES_PER_LOCATION + F.col("n") - 1).alias("id"),
                "restaurant_id",
                F.concat(F.lit("T"), F.col("n").cast("string")).alias("table_number"),
                F.when(F.col("n") <= 3, 4).otherwise(6).alias("seats"),
            )
        )

    @cached_property
    def dishes(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            _location("p_partkey").alias("restaurant_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.col("p_size").alias("prep_time_minutes"),
            (F.col("p_size") > 5).alias("is_available"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        customer = self.raw("customer").select("c_custkey", "c_nationkey", "c_name")
        joined = self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        at_table = F.col("c_nationkey") * TABLES_PER_LOCATION + F.col("o_orderkey") % TABLES_PER_LOCATION
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.col("c_nationkey").alias("restaurant_id"),
            F.when(F.col("o_orderpriority") != "1-URGENT", at_table).alias("table_id"),
            F.col("c_name").alias("guest_name"),
            F.col("o_custkey").alias("created_by_user"),
            F.col("o_orderdate").alias("order_time"),
            _lookup("o_orderstatus", ORDER_STATES).alias("status"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
            (F.col("o_orderstatus") == "F").alias("is_finalized"),
            *_completion(),
        )

    @cached_property
    def orders_by_key(self) -> DataFrame:
        """Orders without their location: no join needed."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("created_by_user"),
            F.col("o_orderdate").alias("order_time"),
            _lookup("o_orderstatus", ORDER_STATES).alias("status"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
            (F.col("o_orderstatus") == "F").alias("is_finalized"),
            *_completion(),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("dish_id"),
            F.col("l_quantity").cast("int").alias("qty"),
            F.col("l_extendedprice").cast(MONEY).alias("price_at_order"),
        )

    @cached_property
    def ingredients(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    @cached_property
    def recipe(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("dish_id"), F.col("l_suppkey").alias("ingredient_id"))
            .agg(F.count(F.lit(1)).cast(QTY).alias("qty_required"))
        )

    def _lines(self, flag: str, id_name: str) -> DataFrame:
        """Lineitem rows of one return flag per (restaurant, ingredient, order)."""
        return (
            self.raw("lineitem")
            .where(F.col("l_returnflag") == flag)
            .groupBy(
                _location("l_partkey").alias("restaurant_id"),
                F.col("l_suppkey").alias("ingredient_id"),
                F.col("l_orderkey").alias(id_name),
            )
        )

    @cached_property
    def batches(self) -> DataFrame:
        return self._lines("R", "id").agg(
            F.sum(F.col("l_quantity").cast("int")).cast(QTY).alias("qty"),
            F.date_add(F.max(F.to_date("l_shipdate")), 30).alias("expiry_date"),
            F.bool_or(F.col("l_linestatus") == "O").alias("active"),
            (F.min("l_linenumber") * 10).cast(QTY).alias("min_threshold"),
        )

    @cached_property
    def consumption(self) -> DataFrame:
        """What each order needs of each ingredient."""
        return self._lines("N", "order_id").agg(
            F.sum(F.col("l_quantity").cast("int")).cast(QTY).alias("need")
        )

    @cached_property
    def purchase_requests(self) -> DataFrame:
        discount = F.col("discount")
        status = (
            F.when(discount == 0, "new")
            .when(discount == 1, "ordered")
            .when(discount <= 5, "received")
            .otherwise("cancelled")
        )
        return (
            self._lines("A", "id")
            .agg(
                F.sum(F.col("l_quantity").cast("int")).cast(QTY).alias("qty"),
                F.min(F.round(F.col("l_discount") * 100).cast("int")).alias("discount"),
                F.max("l_shipdate").alias("created_at"),
            )
            .withColumn("status", status)
            .drop("discount")
        )

    @cached_property
    def employees(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("full_name"),
            F.col("c_mktsegment").alias("position"),
        )

    def _role(self, part: int) -> Column:
        return _lookup("c_mktsegment", {k: v[part] for k, v in SEGMENT_ROLES.items()})

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("employee_id"),
            F.concat(self._role(0), F.col("c_custkey").cast("string")).alias("username"),
        )

    @cached_property
    def roles(self) -> DataFrame:
        return self.raw("customer").select(
            self._role(1).alias("id"), self._role(0).alias("name")
        ).distinct()

    @cached_property
    def user_roles(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            self._role(1).alias("role_id"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("restaurant_id"),
        )

    @cached_property
    def assignments(self) -> DataFrame:
        start = F.col("o_orderdate")
        end = F.when(F.col("o_orderstatus") == "F", start + F.expr("INTERVAL 30 DAYS")).when(
            F.col("o_orderstatus") == "O", start - F.expr("INTERVAL 1 DAY")
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("employee_id"),
            _location("o_orderkey").alias("restaurant_id"),
            start.alias("assigned_from"),
            end.alias("assigned_to"),
        )

    @cached_property
    def order_log(self) -> DataFrame:
        """Orders with a time of day, taken from the event stream."""
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            _location("user_id").alias("restaurant_id"),
            F.col("user_id").alias("created_by_user"),
            F.col("ts").alias("order_time"),
            _lookup("event_type", EVENT_STATES).alias("status"),
        )

    @cached_property
    def log_items(self) -> DataFrame:
        """One item per logged order."""
        return self.raw("events").select(
            F.col("event_id").alias("order_id"), F.floor("value").cast("int").alias("qty")
        )

    @cached_property
    def feedbacks(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("order_id"),
            (F.floor("value").cast("int") % 7).alias("rating"),
        )

    @cached_property
    def reservations(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            _location("user_id").alias("restaurant_id"),
            F.col("ts").alias("reserved_from"),
            (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("reserved_to"),
        )

    @cached_property
    def movements(self) -> DataFrame:
        return self.consumption.select(
            "restaurant_id",
            "ingredient_id",
            F.col("order_id").alias("related_order_id"),
            (-F.col("need")).cast(QTY).alias("change_qty"),
        )

    @cached_property
    def sql_log(self) -> DataFrame:
        """Statements a query log would hold, one per event, with an attack label."""
        return sql_text(self.raw("events"))
