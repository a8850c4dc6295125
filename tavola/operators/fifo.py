"""Earliest-expiry-first depletion of stock, as joins of running totals.

Lots and needs of one key both become end points on a common axis of cumulative
quantity. Between two neighbouring end points exactly one lot serves exactly one
need, so the distance between them is a quantity taken. The cost is linear in
lots plus needs; no pairs are formed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tavola.functions import varints
from tavola.operators.components import GATHERED, components, thinned
from tavola.operators.running import running_total
from tavola.session import cut, store

KEYS = ["restaurant_id", "ingredient_id"]
AMOUNT = "decimal(28,4)"
FAR = dt.date(9999, 12, 31)
#: Needs of orders that a task unfolds and sums, about.
NEEDS_PER_TASK = 16_000_000


def id_bucket(column: str, width: int) -> Column:
    return F.floor(F.col(column) / width).cast("bigint")


def packing():
    """Column of lists of (ingredient_id, units) as bytes."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        row, (ids, no_id), (units, no_units) = _entries(lists, "ingredient_id", "units")
        data, offsets = varints.packed(row, ids, no_id, units, no_units, len(lists))
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

    return pack


def _entries(lists: pa.Array, *names: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], ...]:
    """The list of every entry, and for each field the values and where they are null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    fields = [flat.field(n) for n in names]
    return np.repeat(np.arange(len(lists)), sizes), *[(f.fill_null(0).to_numpy(), f.is_null().to_numpy(zero_copy_only=False)) for f in fields]


def summing():
    """Column of lists of (qty, packed list) of one order as a list of (ingredient_id, units), each ingredient once."""

    @F.arrow_udf("array<struct<ingredient_id bigint, units bigint>>")
    def add(lists: pa.Array) -> pa.Array:
        line_order, (qty, no_qty) = _entries(lists, "qty")
        bytes_ = lists.flatten().field("parts").cast(pa.large_binary())
        offsets = np.frombuffer(bytes_.buffers()[1], np.int64)[bytes_.offset : bytes_.offset + len(bytes_) + 1]
        data = np.frombuffer(bytes_.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        line, ids, no_id, units, no_units = varints.unpacked(data, offsets - offsets[0])
        order, missing = line_order[line], no_units | no_qty[line]
        units, qty = np.where(missing, 0, units), qty[line]
        if np.abs(units.astype(float) * qty).sum() >= 2.0**62:  # may not fit; Python's numbers do, and the last step tells
            units, qty = units.astype(object), qty.astype(object)
        low = ids.min(initial=0)
        width = int(ids.max(initial=0)) - int(low) + 2
        if width * (len(lists) + 1) < 2**63:
            code = np.where(no_id, width - 1, ids - low)
        else:
            code = np.unique(ids, return_inverse=True)[1]
            width = int(code.max(initial=0)) + 2
            code = np.where(no_id, width - 1, code)
        key = order * width + code
        place = np.argsort(key)
        key = key[place]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else place
        summed = np.add.reduceat((units * qty)[place], at) if len(at) else units
        there = np.add.reduceat(~missing[place], at, dtype=np.int64) > 0 if len(at) else missing
        picked = place[at]
        found = pa.StructArray.from_arrays(
            [pa.array(ids[picked], pa.int64(), mask=no_id[picked]), pa.array(summed, pa.int64(), mask=~there)], ["ingredient_id", "units"]
        )
        sizes = np.bincount(order[picked], minlength=len(lists))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), found)

    return add


def demand_lines(items: DataFrame, recipe: DataFrame, orders: DataFrame) -> DataFrame:
    """What each order needs of each ingredient at its location.

    A dish's recipe is one row with a packed list (`varints`), which moves to the orders of the dish before it is unfolded, so the
    needs of an order are made and summed in one task and none of them is shuffled. Orders lie by location, so
    that a task meets an ingredient of its location often and sums of its lines are short. The number of parts
    follows the number of needs: lists are small next to what they unfold to, and must not be merged by their own size.
    """
    place = orders.select(F.col("id").alias("order_id"), "restaurant_id")
    per_dish = items.join(place, "order_id").groupBy("restaurant_id", "order_id", "dish_id").agg(F.sum("qty").alias("qty"))
    # Whole units sum as longs (an overflow is an error), which takes a fraction of the time of wide decimals.
    units = (F.col("qty_required").cast("decimal(28,4)") * 10_000).cast("bigint").alias("units")
    parts = F.collect_list(F.struct(F.col("ingredient_id").cast("bigint").alias("ingredient_id"), units))
    lists = recipe.groupBy("dish_id").agg(parts.alias("parts"), F.count(F.lit(1)).alias("n"))
    lists = store(lists.select("dish_id", "n", packing()("parts").alias("parts")), "recipes")
    sizes = items.groupBy("dish_id").agg(F.count(F.lit(1)).alias("lines")).join(lists.select("dish_id", "n"), "dish_id")
    needs = sizes.agg(F.sum(F.col("lines") * F.col("n"))).first()[0]
    least = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        per_dish.join(lists, "dish_id")
        .repartitionByRange(max(least, (needs or 0) // NEEDS_PER_TASK), "restaurant_id", "order_id")
        .groupBy("restaurant_id", "order_id")
        .agg(summing()(F.collect_list(F.struct("qty", "parts"))).alias("parts"))
        .select("restaurant_id", "order_id", F.inline("parts"))
        .select(
            "restaurant_id",
            F.col("ingredient_id").cast(recipe.schema["ingredient_id"].dataType),
            "order_id",
            (F.col("units") * F.lit(Decimal("0.0001"))).cast(AMOUNT).alias("need"),
        )
    )


def usable(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("active") & (F.col("qty") > 0))


def _ends(df: DataFrame, order: list[str], buckets: dict[str, Column], value: str) -> DataFrame:
    total = {"end": F.col(value).cast(AMOUNT)}
    return running_total(df, KEYS, buckets, [F.asc(c) for c in order], total)


def _lot_ends(batches: DataFrame, width: int) -> DataFrame:
    """Lots in order of expiry (none last), then id."""
    lots = usable(batches).select(
        *KEYS, "id", F.coalesce("expiry_date", F.lit(FAR)).alias("expiry_date"), "qty"
    )
    buckets = {"_day": F.col("expiry_date"), "_ids": id_bucket("id", width)}
    ends = _ends(lots, ["id"], buckets, "qty")
    return ends.select(*KEYS, F.col("end").cast(AMOUNT).alias("end"), F.col("id").alias("batch_id"))


def _need_ends(needs: DataFrame, width: int) -> DataFrame:
    wanted = needs.where(F.col("need") > 0).select(*KEYS, "order_id", "need")
    ends = _ends(wanted, ["order_id"], {"_ids": id_bucket("order_id", width)}, "need")
    return ends.select(*KEYS, F.col("end").cast(AMOUNT).alias("end"), "order_id")


def segments(
    batches: DataFrame, needs: DataFrame, width: int = 65536, span: float = 65536.0
) -> DataFrame:
    """(keys, order_id, batch_id, take, runs_past) over the whole axis of each key.

    A NULL batch is unmet need, a NULL order is stock left over. `runs_past` marks
    the end of a batch whose need goes on. `needs` has one row per (keys,
    order_id). `width` ids and `span` units bound a window's rows.
    """
    none = F.lit(None).cast("bigint")
    lots = _lot_ends(batches, width).withColumn("order_id", none)
    wanted = _need_ends(needs, width).withColumn("batch_id", none)
    points = lots.unionByName(wanted).withColumn(
        "_b", F.floor(F.col("end").cast("double") / span).cast("bigint")
    ).where(F.col("_b").isNotNull())
    # Descending order: the last id seen is the next one along the axis. A lot and
    # a need may end at one point; as peers they see each other, and the second of
    # them gets a distance of zero.
    inside = W.partitionBy(*KEYS, "_b").orderBy(F.desc("end"))
    seen = inside.rangeBetween(W.unboundedPreceding, W.currentRow)
    here = inside.rangeBetween(W.currentRow, W.currentRow)
    rows = points.select(
        *KEYS,
        "_b",
        "end",
        F.last("batch_id", True).over(seen).alias("batch_id"),
        F.last("order_id", True).over(seen).alias("order_id"),
        (F.max("batch_id").over(here).isNotNull() & F.max("order_id").over(here).isNull()).alias("lot_only"),
        F.lead("end").over(inside).alias("start"),
    )
    outer = W.partitionBy(*KEYS).orderBy(F.desc("_b"))
    later = outer.rowsBetween(W.unboundedPreceding, -1)
    edges = (
        rows.groupBy(*KEYS, "_b")
        .agg(
            F.min_by("batch_id", "end").alias("b"),
            F.min_by("order_id", "end").alias("o"),
            F.max("end").alias("e"),
        )
        .select(
            *KEYS,
            "_b",
            F.last("b", True).over(later).alias("next_batch"),
            F.last("o", True).over(later).alias("next_order"),
            F.lead("e").over(outer).alias("prev_end"),
        )
    )
    start = F.coalesce("start", "prev_end", F.lit(0).cast(AMOUNT))
    order = F.coalesce("order_id", "next_order")
    return (
        rows.join(edges, [*KEYS, "_b"])
        .select(
            *KEYS,
            order.alias("order_id"),
            F.coalesce("batch_id", "next_batch").alias("batch_id"),
            (F.col("end") - start).cast(AMOUNT).alias("take"),
            (F.col("lot_only") & order.isNotNull()).alias("runs_past"),
        )
        .where(F.col("take") > 0)
    )


def fifo_allocate(batches: DataFrame, needs: DataFrame, **size) -> DataFrame:
    """(keys, order_id, batch_id, take) in order of `order_id`; short needs are part filled."""
    return allocated(segments(batches, needs, **size))


def allocated(axis: DataFrame) -> DataFrame:
    """The allocation of `segments`."""
    met = F.col("order_id").isNotNull() & F.col("batch_id").isNotNull()
    return axis.where(met).drop("runs_past")


def fifo_shortage(batches: DataFrame, needs: DataFrame, width: int = 65536) -> DataFrame:
    """(keys, order_id, short_qty) of needs the stock does not cover.

    A need lacks what its running total exceeds the key's supply by, at most itself.
    """
    supply = usable(batches).groupBy(*KEYS).agg(F.sum("qty").cast(AMOUNT).alias("supply"))
    wanted = needs.where(F.col("need") > 0).select(*KEYS, "order_id", F.col("need").cast(AMOUNT).alias("need"))
    ends = _ends(wanted, ["order_id"], {"_ids": id_bucket("order_id", width)}, "need")
    over = F.col("end") - F.coalesce("supply", F.lit(0))
    short = F.least("need", over).cast(AMOUNT)
    return ends.join(supply, KEYS, "left").where(over > 0).select(*KEYS, "order_id", short.alias("short_qty"))


def movements(allocation: DataFrame) -> DataFrame:
    """Stock movements of an allocation: negative changes with their order."""
    return allocation.select(
        "batch_id",
        "ingredient_id",
        "restaurant_id",
        (-F.col("take")).alias("change_qty"),
        F.lit("order").alias("reason"),
        F.col("order_id").alias("related_order_id"),
    )


def deplete(batches: DataFrame, needs: DataFrame, **size) -> DataFrame:
    """Batches after the allocation.

    A batch a need runs past is emptied and turned inactive; one that is used up
    exactly stays active with nothing left.
    """
    return depleted(batches, segments(batches, needs, **size))


def depleted(batches: DataFrame, axis: DataFrame) -> DataFrame:
    """The same for the `segments` of these batches."""
    served = F.col("order_id").isNotNull() & F.col("batch_id").isNotNull()
    state = (
        axis.where(served)
        .groupBy(*KEYS, F.col("batch_id").alias("id"))
        .agg(F.sum("take").alias("taken"), F.bool_or("runs_past").alias("run_past"))
    )
    left = F.col("qty") - F.coalesce("taken", F.lit(0))
    emptied = F.coalesce("run_past", F.lit(False))
    return (
        batches.join(state, [*KEYS, "id"], "left")
        .withColumn("active", F.col("active") & ~emptied)
        .withColumn("qty", left.cast("decimal(12,4)"))
        .drop("taken", "run_past")
    )


def accepted_orders(batches: DataFrame, needs: DataFrame, width: int = 65536) -> DataFrame:
    """(order_id, accepted) when an order with any shortage is refused as a whole.

    Orders are taken in order of `order_id`, and a refused one uses no stock, at any of its
    locations. The number of jobs does not depend on the number of orders:

    1. A key whose needs fit its supply together binds no order.
    2. The other keys are grouped by the orders that need several of them, at one location or
       at several. An order lies in one group, so groups are independent.
    3. Sums of buckets of `width` ids tell in which bucket a group's first key runs out; the
       orders of all earlier buckets are accepted. The rest of a group is walked once, in order, in a
       stream that holds the quantities taken per key and the lines of one order.
    """
    return accepted_of(batches, wanted_lines(needs), width)


def wanted_lines(needs: DataFrame) -> DataFrame:
    """Needs above zero, kept for several passes."""
    return cut(needs.where(F.col("need") > 0).select(*KEYS, "order_id", F.col("need").cast(AMOUNT).alias("need")))


def accepted_of(batches: DataFrame, wanted: DataFrame, width: int = 65536) -> DataFrame:
    """`accepted_orders` of needs that went through `wanted_lines`."""
    supply = usable(batches).groupBy(*KEYS).agg(F.sum("qty").cast(AMOUNT).alias("supply"))
    have = F.coalesce("supply", F.lit(0)).cast(AMOUNT)
    total = wanted.groupBy(*KEYS).agg(F.sum("need").alias("total")).join(supply, KEYS, "left")
    binding = total.where(F.col("total") > have).select(*KEYS, have.alias("supply"))
    lines = _grouped(wanted.join(binding, KEYS)).withColumn("_b", id_bucket("order_id", width))
    sums = lines.groupBy("group", *KEYS, "_b", "supply").agg(F.sum("need").alias("need"))
    so_far = F.sum("need").over(W.partitionBy(*KEYS).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    sums = cut(sums.withColumn("out", so_far > F.col("supply")))
    first = sums.where("out").groupBy("group").agg(F.min("_b").alias("first"))
    used = sums.join(first, "group").where("_b < first").groupBy(*KEYS).agg(F.sum("need").alias("used"))
    open_ = lines.join(first, "group").where("_b >= first").join(used, KEYS, "left")
    room = F.col("supply") - F.coalesce("used", F.lit(0))
    units = [(v * 10_000).cast("decimal(38,0)").cast("bigint").alias(c) for c, v in (("need", F.col("need")), ("room", room))]
    # A number of parts of its own: groups are long walks over few bytes, and must not be merged by their size.
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        open_.select("group", "order_id", F.concat_ws(":", *KEYS).alias("key"), *units)
        .repartition(parts, "group")
        .sortWithinPartitions("group", "order_id")
    )
    verdicts = ordered.mapInArrow(_walk, f"order_id {wanted.schema['order_id'].dataType.simpleString()}, accepted boolean")
    orders = wanted.select("order_id").distinct().join(verdicts, "order_id", "left")
    return orders.select("order_id", F.coalesce("accepted", F.lit(True)).alias("accepted"))


def _grouped(lines: DataFrame) -> DataFrame:
    """Lines with `group`: keys that an order needs together, directly or over others, are in one.

    A key is named by a hash; two keys of one name only make two groups one.
    """
    lines = store(lines.withColumn("group", F.xxhash64(*KEYS)), "lines")
    spans = lines.groupBy("order_id").agg(F.min("group").alias("u"), F.collect_set("group").alias("groups")).where(F.size("groups") > 1)
    # Each task replaces the links of its orders by a forest, so there are at most as many links as keys that a task has.
    links = spans.select("u", F.explode("groups").alias("v")).where("u != v")
    links = store(links.mapInPandas(thinned, "u long, v long"), "links")
    found = links.count()
    if not found:
        return lines
    if found <= GATHERED:
        whole = links.repartition(1).mapInPandas(thinned, "u long, v long")
    else:
        whole = components(links, "u", "v").toDF("u", "v")
    whole = store(whole.toDF("group", "whole"), "groups")
    return lines.join(whole, "group", "left").withColumn("group", F.coalesce("whole", "group")).drop("whole")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders of sorted groups (group, order_id, key, need, room), decided one after the other."""
    group = order = None
    taken: dict[str, int] = {}
    lines: list[tuple[str, int, int]] = []
    orders: list = []
    verdicts: list[bool] = []

    def decide() -> None:
        good = all(taken.get(k, 0) + need <= room for k, need, room in lines)
        if good:
            for k, need, _ in lines:
                taken[k] = taken.get(k, 0) + need
        orders.append(order)
        verdicts.append(good)

    for batch in batches:
        id_type = batch.column(1).type
        for of, number, key, need, room in zip(*(c.to_pylist() for c in batch.columns)):
            if number != order or of != group:
                if lines:
                    decide()
                if of != group:
                    group, taken = of, {}
                order, lines = number, []
            lines.append((key, need, room))
        yield pa.RecordBatch.from_arrays([pa.array(orders, id_type), pa.array(verdicts, pa.bool_())], ["order_id", "accepted"])
        orders, verdicts = [], []
    if lines:
        decide()
        yield pa.RecordBatch.from_arrays([pa.array(orders, id_type), pa.array(verdicts, pa.bool_())], ["order_id", "accepted"])


def fifo_allocate_strict(batches: DataFrame, needs: DataFrame, width: int = 65536, **size) -> DataFrame:
    """Allocation in which an order with any shortage takes nothing."""
    wanted = wanted_lines(needs)
    refused = accepted_of(batches, wanted, width).where("NOT accepted").select("order_id")
    return fifo_allocate(batches, wanted.join(refused, "order_id", "left_anti"), width=width, **size)
