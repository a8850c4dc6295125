"""Streaming jobs run over the files that are there, checked against their batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola.plans.guard import LOG, SCAN
from tavola.operators import access
from tavola.plans.registry import query
from tavola.plans.rules import VIEWERS, viewers
from tavola.session import cut, shared_dir
from tavola.sources.chain import Chain
from tavola.streaming import changes, jobs


class StreamChain(Chain):
    """The chain's tables read as streams, whether a table is a file or a folder."""

    def raw(self, name):
        return jobs.read_files(self.spark, self.folder, f"{name}.parquet")


@query(
    "o76_streaming_order_totals",
    """SELECT order_id, CAST(SUM(qty * price_at_order) AS DOUBLE) AS total_amount FROM d_items GROUP BY 1""",
)
def _(c):
    live = StreamChain(c.spark, c.folder)
    return jobs.finished(jobs.order_totals(live.items), "update", lambda r: jobs.latest(r, ["order_id"]))


@query(
    "o77_streaming_hourly_load",
    """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id,
              strftime(date_trunc('hour', order_time), '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS orders_count
       FROM d_order_log GROUP BY 1, 2""",
)
def _(c):
    live = StreamChain(c.spark, c.folder)
    keys = ["restaurant_id", "hour_start"]
    return jobs.finished(jobs.hourly_load(live.order_log), "update", lambda r: jobs.latest(r, keys))


@query(
    "o78_streaming_screening",
    f"""WITH {LOG} SELECT log_id, allowed, layer, CASE WHEN NOT white THEN COALESCE(structure, rule) END AS reason
        FROM ({SCAN})""",
)
def _(c):
    live = StreamChain(c.spark, c.folder)
    log = live.sql_log.select("log_id", "sql")
    return jobs.finished(jobs.screened(log), "append", lambda r: r.select("log_id", "allowed", "layer", "reason"))


def _changes(c):
    """A log of item changes: all lines come in, some are then changed, moved to the next order or deleted."""
    line = F.col("l_linenumber")
    # An order may hold a line number more than once; together these are one item.
    lines = c.raw("lineitem").groupBy(F.col("l_orderkey").cast("long").alias("order"), line.alias("line")).agg(
        F.sum(F.col("l_quantity").cast("int")).cast("int").alias("qty"),
        F.max(F.col("l_extendedprice").cast("decimal(12,2)")).alias("price_at_order"),
    )
    lines = lines.withColumn("item_id", (F.col("order") * 10 + F.col("line")).cast("long"))
    none, order = F.lit(None).cast("long"), F.col("order")
    come = lines.select("item_id", F.lit(1).cast("long").alias("version"), none.alias("old_order_id"), order.alias("order_id"), "qty", "price_at_order")
    later = lines.where("line IN (2, 3, 4)").select(
        "item_id",
        F.lit(2).cast("long").alias("version"),
        order.alias("old_order_id"),
        F.when(F.col("line") == 2, order).when(F.col("line") == 3, order + 1).alias("order_id"),
        F.when(F.col("line") == 2, F.col("qty") + 1).otherwise(F.col("qty")).alias("qty"),
        "price_at_order",
    )
    return come, later


@query(
    "o76_replayed_changes",
    """WITH items AS (
           SELECT l_orderkey, l_linenumber, SUM(CAST(l_quantity AS INT)) AS qty, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS price
           FROM lineitem GROUP BY 1, 2),
       now AS (
           SELECT CASE WHEN l_linenumber = 3 THEN l_orderkey + 1 ELSE l_orderkey END AS order_id,
                  (qty + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) * price AS v
           FROM items WHERE l_linenumber <> 4)
       SELECT o.order_id, CAST(COALESCE(SUM(v), 0) AS DOUBLE) AS total_amount
       FROM (SELECT DISTINCT l_orderkey AS order_id FROM lineitem UNION SELECT l_orderkey + 1 FROM lineitem WHERE l_linenumber = 3) o
       LEFT JOIN now USING (order_id) GROUP BY 1""",
)
def _(c):
    """Totals after a log of changes whose first part comes a second time at the end."""
    folder = f"{shared_dir(c.spark)}/changes-{uuid.uuid4().hex}"
    come, later = _changes(c)
    for part in (come, later, come.where("item_id % 2 = 0")):
        part.write.mode("append").parquet(folder)
    live = jobs.read_files(c.spark, folder, "*.parquet")
    try:
        return jobs.finished(changes.order_totals(live), "update", lambda r: jobs.latest(r, ["order_id"]))
    finally:
        jobs.remove(c.spark, folder)


@query(
    "o123_streamed_inserts",
    f"""WITH v AS ({VIEWERS})
        SELECT i.l_orderkey AS order_id, i.l_suppkey AS user_id,
               COALESCE(v.role = 'admin' OR (v.role IN ('manager', 'waiter') AND v.restaurant_id = o.restaurant_id), false)
               AS accepted
        FROM lineitem i LEFT JOIN d_orders o ON o.id = i.l_orderkey LEFT JOIN v ON v.user_id = i.l_suppkey""",
)
def _(c):
    """Proposed items as a stream, checked against the orders and accounts, accepted and rejected ones apart."""
    live = StreamChain(c.spark, c.folder).raw("lineitem")
    proposed = live.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("user_id"))
    folder = f"{shared_dir(c.spark)}/inserts-{uuid.uuid4().hex}"
    who = viewers(c)
    good, bad = jobs.run_guarded(proposed, lambda rows: access.check_item_inserts(rows, c.orders, who), folder, f"{folder}/state")
    sides = [jobs.results(c.spark, f).drop("batch").withColumn("accepted", F.lit(flag)) for f, flag in ((good, True), (bad, False))]
    result = cut(sides[0].unionByName(sides[1]))
    jobs.remove(c.spark, folder)
    return result
