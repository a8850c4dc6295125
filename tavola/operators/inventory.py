"""Order totals, stock on hand, availability, reorder and expiry jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tavola.functions.predicates import fill_zero
from tavola.operators.fifo import AMOUNT, KEYS, accepted_of, allocated, depleted, movements, segments, wanted_lines
from tavola.operators.reports import revenue
from tavola.session import cut, store

# Request states that count as open, the threshold used when no
# batch has one, and the factor from threshold to requested quantity.
OPEN_REQUESTS = ("new", "ordered")
DEFAULT_THRESHOLD = 5
REORDER_FACTOR = 10


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Total per order, 0 for an order without items."""
    totals = items.groupBy(F.col("order_id").alias("id")).agg(F.sum(revenue()).alias("total_amount"))
    return orders.select("id").join(totals, "id", "left").withColumn(
        "total_amount", fill_zero(F.col("total_amount"))
    )


def on_hand(batches: DataFrame) -> DataFrame:
    """Active quantity per (location, ingredient), 0 where all batches are inactive."""
    return batches.groupBy(*KEYS).agg(
        fill_zero(F.sum(F.when(F.col("active"), F.col("qty")))).alias("total_qty")
    )


def dish_availability(dishes: DataFrame, recipe: DataFrame, batches: DataFrame) -> DataFrame:
    """(id, restaurant_id, is_available): no recipe line short of stock."""
    place = dishes.select(F.col("id").alias("dish_id"), "restaurant_id")
    short = fill_zero(F.col("total_qty")) < F.col("qty_required")
    missing = (
        recipe.join(place, "dish_id")
        .join(on_hand(batches), KEYS, "left")
        .groupBy(F.col("dish_id").alias("id"))
        .agg(F.count_if(short).alias("missing"))
    )
    return dishes.select("id", "restaurant_id").join(missing, "id", "left").select(
        "id", "restaurant_id", (fill_zero(F.col("missing")) == 0).alias("is_available")
    )


def reorder(after: DataFrame, touched: DataFrame, requests: DataFrame) -> DataFrame:
    """New purchase requests for touched keys at or under their threshold.

    `after` holds the batches after depletion, `touched` the keys that were used.
    """
    levels = after.groupBy(*KEYS).agg(
        F.coalesce(F.min("min_threshold"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        fill_zero(F.sum(F.when(F.col("active"), F.col("qty")))).alias("left_qty"),
    )
    keys = touched.select(*KEYS).distinct()
    open_ = requests.where(F.col("status").isin(*OPEN_REQUESTS)).select(*KEYS).distinct()
    threshold = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    return (
        keys.join(levels, KEYS, "left")
        .where(fill_zero(F.col("left_qty")) <= threshold)
        .join(open_, KEYS, "left_anti")
        .select(*KEYS, (threshold * REORDER_FACTOR).alias("qty"), F.lit("new").alias("status"))
    )


def reorder_after(batches: DataFrame, needs: DataFrame, requests: DataFrame) -> DataFrame:
    """New purchase requests once `needs` are served in part or whole, without the depletion itself.

    What is left of a key is its active stock minus the smaller of its need and its
    usable stock; which batch it comes from does not matter.
    """
    active = F.col("active")
    levels = batches.groupBy(*KEYS).agg(
        F.min("min_threshold").alias("threshold"),
        fill_zero(F.sum(F.when(active, F.col("qty")))).cast(AMOUNT).alias("stock"),
        fill_zero(F.sum(F.when(active & (F.col("qty") > 0), F.col("qty")))).cast(AMOUNT).alias("usable"),
    )
    wanted = needs.groupBy(*KEYS).agg(F.sum(F.when(F.col("need") > 0, F.col("need")).otherwise(0)).cast(AMOUNT).alias("need"))
    open_ = requests.where(F.col("status").isin(*OPEN_REQUESTS)).select(*KEYS).distinct()
    threshold = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    left_qty = fill_zero(F.col("stock") - F.least("need", "usable"))
    return (
        wanted.join(levels, KEYS, "left")
        .where(left_qty <= threshold)
        .join(open_, KEYS, "left_anti")
        .select(*KEYS, (threshold * REORDER_FACTOR).alias("qty"), F.lit("new").alias("status"))
    )


def expire(batches: DataFrame, today: dt.date) -> DataFrame:
    """Batches past their date made inactive."""
    late = F.coalesce(F.col("expiry_date") < F.lit(today), F.lit(False))
    return batches.withColumn("active", F.col("active") & ~late)


def finalise(
    orders: DataFrame, at: dt.datetime, user: int | str | None = None, accepted: DataFrame | None = None
) -> DataFrame:
    """Orders completed at `at` by `user`, or by who created them.

    Orders already final stay as they are, with their completion values; so do those that `accepted`
    (order_id, accepted) refuses. Orders it does not list need no stock and are completed.
    """
    open_ = ~F.col("is_finalized")
    source = orders
    if accepted is not None:
        refused = accepted.where(~F.col("accepted")).select(F.col("order_id").alias("id"), F.lit(True).alias("_refused"))
        source = orders.join(refused, "id", "left")
        open_ = open_ & F.col("_refused").isNull()
    by = F.coalesce(F.lit(user).cast(orders.schema["created_by_user"].dataType), F.col("created_by_user"))
    return source.select(
        "id",
        F.when(open_, F.lit("completed")).otherwise(F.col("status")).alias("status"),
        (F.col("is_finalized") | open_).alias("is_finalized"),
        F.when(open_, F.lit(str(at)).cast("timestamp_ntz")).otherwise(F.col("completed_at").cast("timestamp_ntz")).alias("completed_at"),
        F.when(open_, by).otherwise(F.col("completed_by_user")).alias("completed_by_user"),
    )


def finalise_all(
    orders: DataFrame, needs: DataFrame, batches: DataFrame, dishes: DataFrame, recipe: DataFrame,
    at: dt.datetime, user: int | str | None = None,
) -> dict[str, DataFrame]:
    """All open orders in order of id: `orders` completed where stock serves them whole, `movements`,
    `batches` after them and `dishes` with their availability.

    `needs` holds the lines of the open orders.
    """
    wanted = wanted_lines(needs)
    verdict = cut(accepted_of(batches, wanted))
    good = wanted.join(verdict.where("accepted").select("order_id"), "order_id", "left_semi")
    # Movements, batches and dishes all read it.
    axis = store(segments(batches, good), "axis")
    after = depleted(batches, axis)
    return {
        "orders": finalise(orders, at, user, verdict),
        "movements": movements(allocated(axis)),
        "batches": after,
        "dishes": dish_availability(dishes, recipe, after),
    }


def manual_requests(batches: DataFrame, chosen: DataFrame, qty: float | None = None) -> DataFrame:
    """One request per chosen batch: `qty`, else its threshold, else 1.

    `chosen` has the columns of `batches` that identify one.
    """
    amount = F.lit(qty) if qty is not None else F.coalesce(
        F.nullif("min_threshold", F.lit(0)), F.lit(1)
    )
    return batches.join(chosen, chosen.columns, "left_semi").select(
        *KEYS, amount.cast("decimal(12,4)").alias("qty"), F.lit("new").alias("status")
    )


def adjust(batches: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Batches with `qty` and `expiry_date` replaced where `changes` gives them."""
    new = changes.select(
        *keys, F.col("qty").alias("_qty"), F.col("expiry_date").alias("_expiry")
    )
    return (
        batches.join(new, keys, "left")
        .withColumn("qty", F.coalesce("_qty", "qty"))
        .withColumn("expiry_date", F.coalesce("_expiry", "expiry_date"))
        .drop("_qty", "_expiry")
    )
