"""Order totals from a stream of item changes: inserts, updates and deletes.

A change tells what an item was (`old_order_id`, null for an insert) and is (`order_id`, `qty`,
`price_at_order`; null order for a delete), with a `version` that grows from change to change of
one item. Each change becomes one row for every order it touches. The state of an order
holds the last version and the amount of each item it has or had, so a change that comes
twice, or after a later one of the same item, changes nothing. Totals are written for
the orders of a micro-batch.

State is keyed by `ORDERS` neighbouring orders: a row holds their items (RocksDB on the executors), comes to the task with the
changes and goes back once, so there is no call for each item or order. The size of all is that of the items ever seen,
and a task reads the items of the rows that a batch's orders are in.

Defined results: a change without item or version is ignored; null quantities or prices count 0; an
order without items has the total 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

AMOUNT = "decimal(28,4)"
#: Orders that share a row of state.
ORDERS = 32
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def signed(changes: DataFrame) -> DataFrame:
    """(order_id, item_id, version, amount): a null amount takes the item out of the order."""
    value = (F.coalesce("qty", F.lit(0)) * F.coalesce("price_at_order", F.lit(0))).cast(AMOUNT)
    left = F.struct(F.col("old_order_id").alias("order_id"), F.lit(None).cast(AMOUNT).alias("amount"))
    come = F.struct(F.col("order_id").alias("order_id"), value.alias("amount"))
    moved = F.col("old_order_id").isNotNull() & ~F.col("old_order_id").eqNullSafe(F.col("order_id"))
    touched = F.filter(F.array(F.when(moved, left), F.when(F.col("order_id").isNotNull(), come)), lambda x: x.isNotNull())
    known = changes.where("item_id IS NOT NULL AND version IS NOT NULL")
    return known.select("item_id", "version", F.explode(touched).alias("t")).select("t.order_id", "item_id", "version", "t.amount")


def _last_items(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The items of `ORDERS` orders; totals of those that `parts` touch."""
    held: dict[tuple[int, int], tuple[int, Decimal | None]] = {}
    if state.exists:
        orders, items, versions, amounts = state.get
        held = dict(zip(zip(orders, items), zip(versions, amounts)))
    totals: dict[int, Decimal] = {}
    for part in parts:
        for order, item, version, amount in zip(*(part[c].tolist() for c in ("order_id", "item_id", "version", "amount"))):
            totals[order] = Decimal(0)
            last = held.get((order, item))
            if last is None or version > last[0]:
                held[order, item] = version, amount
    for (order, _), (_, amount) in held.items():
        if order in totals and amount is not None:
            totals[order] += amount
    state.update(([o for o, _ in held], [i for _, i in held], [v for v, _ in held.values()], [a for _, a in held.values()]))
    yield pd.DataFrame({"order_id": list(totals), "total_amount": list(totals.values())})


def order_totals(changes: DataFrame) -> DataFrame:
    """(order_id, total_amount) of the orders that each micro-batch touches, for update mode."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    placed = signed(changes).withColumn("_orders", F.floor(F.col("order_id") / ORDERS).cast("bigint"))
    return placed.groupBy("_orders").applyInPandasWithState(
        _last_items,
        f"order_id bigint, total_amount {AMOUNT}",
        f"orders array<bigint>, items array<bigint>, versions array<bigint>, amounts array<{AMOUNT}>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
