"""Inventory, capacity and recommendation jobs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tavola.operators import capacity as cap, fifo, inventory as inv
from tavola.plans.registry import query
from tavola.session import shared_dir
from tavola.sources import snapshots

TODAY = dt.date(2001, 8, 1)

LOC = "CAST(restaurant_id AS BIGINT) AS restaurant_id"

ETA = """
    SELECT r.id, r.city_id, r.name,
           CASE WHEN COALESCE(a.n, 0) >= r.max_concurrent_orders
                THEN (COALESCE(a.n, 0) - r.max_concurrent_orders + 1) * COALESCE(p.prep, 20) END AS eta_minutes
    FROM d_capacities r
    LEFT JOIN (SELECT restaurant_id, count(*) AS n FROM d_orders
               WHERE status IN ('created', 'confirmed', 'preparing') GROUP BY 1) a ON a.restaurant_id = r.id
    LEFT JOIN (SELECT restaurant_id, CAST(round(avg(prep_time_minutes)) AS INT) AS prep
               FROM d_dishes GROUP BY 1) p ON p.restaurant_id = r.id"""


@query(
    "o63_order_totals",
    """SELECT o.id, COALESCE(CAST(t.s AS DOUBLE), 0) AS total_amount FROM d_orders o
       LEFT JOIN (SELECT order_id, SUM(qty * price_at_order) AS s FROM d_items GROUP BY 1) t ON t.order_id = o.id""",
)
def _(c):
    return inv.order_totals(c.orders_by_key, c.items)


@query(
    "o64_location_eta",
    f"""SELECT CAST(id AS BIGINT) AS id, CAST(city_id AS BIGINT) AS city_id, name,
               CAST(eta_minutes AS BIGINT) AS eta_minutes FROM ({ETA})""",
)
def _(c):
    return cap.location_eta(c.capacities, c.orders, c.dishes)


@query(
    "o65_alternative_locations",
    f"""
        WITH eta AS MATERIALIZED ({ETA}),
        ranked AS (SELECT a.id AS restaurant_id, b.id, b.name, b.eta_minutes,
                          row_number() OVER (PARTITION BY a.id ORDER BY b.eta_minutes NULLS FIRST, b.id) AS rank
                   FROM eta a JOIN eta b ON a.city_id = b.city_id AND a.id <> b.id
                   WHERE b.eta_minutes IS NULL OR b.eta_minutes < 60)
        SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, CAST(rank AS BIGINT) AS rank, CAST(id AS BIGINT) AS id,
               name, CAST(eta_minutes AS BIGINT) AS eta_minutes FROM ranked WHERE rank <= 3""",
)
def _(c):
    return cap.alternative_locations(cap.location_eta(c.capacities, c.orders, c.dishes))


@query(
    "o27_other_locations",
    """SELECT a.s_suppkey AS id, count(*) AS others FROM supplier a
       JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1""",
)
def _(c):
    sites = c.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("city_id"))
    return cap.others_in_city(sites)


@query(
    "o66_alternative_dishes",
    """SELECT for_id, for_name, CAST(restaurant_id AS BIGINT) AS restaurant_id, rank, dish_id, name,
              CAST(1.0 AS DOUBLE) AS similarity_score
       FROM (SELECT a.id AS for_id, a.name AS for_name, a.restaurant_id, b.id AS dish_id, b.name,
                    row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rank
             FROM d_dishes a JOIN d_dishes b ON a.restaurant_id = b.restaurant_id AND a.category = b.category
                  AND a.id <> b.id WHERE b.is_available) WHERE rank <= 5""",
)
def _(c):
    return cap.alternative_dishes(c.dishes)


@query(
    "o23_alternatives_for_unavailable",
    """SELECT u.name AS unavailable_dish, r.name AS restaurant, alt.name AS alternative_dish
       FROM d_dishes u JOIN d_restaurants r ON u.restaurant_id = r.id
       JOIN LATERAL (SELECT b.name FROM d_dishes b WHERE b.restaurant_id = u.restaurant_id AND b.category = u.category
                     AND b.is_available AND b.id <> u.id ORDER BY b.id LIMIT 3) alt ON true
       WHERE NOT u.is_available""",
)
def _(c):
    return cap.alternatives_for_unavailable(c.dishes, c.restaurants)


ON_HAND = """SELECT restaurant_id, ingredient_id, SUM(CASE WHEN active THEN qty ELSE 0 END) AS total_qty
             FROM d_batches GROUP BY 1, 2"""


@query(
    "o67_on_hand",
    f"SELECT {LOC}, ingredient_id, CAST(total_qty AS DOUBLE) AS total_qty FROM ({ON_HAND})",
)
def _(c):
    return inv.on_hand(c.batches)


def _availability(batches: str) -> str:
    return f"""
        SELECT d.id, CAST(d.restaurant_id AS BIGINT) AS restaurant_id, COALESCE(m.missing, 0) = 0 AS is_available
        FROM d_dishes d LEFT JOIN (
            SELECT rc.dish_id, count(*) AS missing FROM d_recipe rc JOIN d_dishes x ON x.id = rc.dish_id
            LEFT JOIN (SELECT restaurant_id, ingredient_id, SUM(CASE WHEN active THEN qty ELSE 0 END) AS total_qty
                       FROM {batches} GROUP BY 1, 2) h
                   ON h.restaurant_id = x.restaurant_id AND h.ingredient_id = rc.ingredient_id
            WHERE COALESCE(h.total_qty, 0) < rc.qty_required GROUP BY 1) m ON m.dish_id = d.id"""


@query("o68_dish_availability", _availability("d_batches"))
def _(c):
    return inv.dish_availability(c.dishes, c.recipe, c.batches)


EXPIRED = """SELECT restaurant_id, ingredient_id, id, qty, expiry_date, min_threshold,
                    active AND NOT COALESCE(expiry_date < DATE '2001-08-01', false) AS active FROM d_batches"""


@query(
    "o71_expiry_sweep",
    f"""SELECT {LOC}, ingredient_id, CAST(sum(CAST(active AS INT)) AS BIGINT) AS active_batches, count(*) AS batches
        FROM ({EXPIRED}) GROUP BY 1, 2""",
)
def _(c):
    swept = inv.expire(c.batches, TODAY)
    return swept.groupBy(*fifo.KEYS).agg(
        F.count_if("active").alias("active_batches"), F.count(F.lit(1)).alias("batches")
    )


@query("o71_availability_after_sweep", _availability(f"({EXPIRED})"))
def _(c):
    return inv.dish_availability(c.dishes, c.recipe, inv.expire(c.batches, TODAY))


FIFO = """
    WITH lot AS (
        SELECT *, SUM(qty) OVER (PARTITION BY restaurant_id, ingredient_id ORDER BY expiry_date NULLS LAST, id) AS hi
        FROM d_batches WHERE active AND qty > 0),
    want AS (
        SELECT *, SUM(need) OVER (PARTITION BY restaurant_id, ingredient_id ORDER BY order_id) AS hi FROM d_consumption),
    take AS (
        SELECT l.restaurant_id, l.ingredient_id, w.order_id, l.id AS batch_id,
               least(l.hi, w.hi) - greatest(l.hi - l.qty, w.hi - w.need) AS take, w.hi AS need_end, l.hi AS lot_end
        FROM lot l JOIN want w ON l.restaurant_id = w.restaurant_id AND l.ingredient_id = w.ingredient_id
             AND l.hi > w.hi - w.need AND w.hi > l.hi - l.qty)"""


@query(
    "o69_fifo_allocate",
    f"{FIFO} SELECT {LOC}, ingredient_id, order_id, batch_id, CAST(take AS DOUBLE) AS take FROM take",
)
def _(c):
    return fifo.fifo_allocate(c.batches, c.consumption)


@query(
    "o69_fifo_shortage",
    f"""{FIFO} SELECT CAST(w.restaurant_id AS BIGINT) AS restaurant_id, w.ingredient_id, w.order_id,
                      CAST(w.need - COALESCE(t.taken, 0) AS DOUBLE) AS short_qty
        FROM want w LEFT JOIN (SELECT restaurant_id, ingredient_id, order_id, SUM(take) AS taken FROM take GROUP BY 1, 2, 3) t
             USING (restaurant_id, ingredient_id, order_id) WHERE w.need > COALESCE(t.taken, 0)""",
)
def _(c):
    return fifo.fifo_shortage(c.batches, c.consumption)


@query(
    "o69_demand_lines",
    """SELECT CAST(o.restaurant_id AS BIGINT) AS restaurant_id, rc.ingredient_id, count(DISTINCT o.id) AS orders,
              CAST(SUM(rc.qty_required * i.qty) AS DOUBLE) AS need
       FROM d_items i JOIN d_orders o ON o.id = i.order_id JOIN d_recipe rc ON rc.dish_id = i.dish_id GROUP BY 1, 2""",
)
def _(c):
    lines = fifo.demand_lines(c.items, c.recipe, c.orders)
    return lines.groupBy(*fifo.KEYS).agg(F.count("order_id").alias("orders"), F.sum("need").alias("need"))


@query(
    "o69_movements",
    f"""{FIFO} SELECT {LOC}, ingredient_id, batch_id, CAST(-take AS DOUBLE) AS change_qty, 'order' AS reason, order_id AS related_order_id
        FROM take""",
)
def _(c):
    return fifo.movements(fifo.fifo_allocate(c.batches, c.consumption))


@query("o71b_finalise_all")
def _(c):
    open_ = c.orders_by_key.where("NOT is_finalized")
    needs = c.consumption.join(open_.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    made = inv.finalise_all(c.orders_by_key, needs, c.batches, c.dishes, c.recipe, dt.datetime(2001, 8, 1, 12))
    moved = made["movements"].groupBy(F.col("related_order_id").alias("id")).agg(
        F.count(F.lit(1)).alias("movements"), F.sum("change_qty").alias("change_qty")
    )
    return made["orders"].join(moved, "id", "left")


@query(
    "o71b_committed",
    """SELECT 'batches' AS name, CAST(count(*) AS DOUBLE) AS value FROM d_batches
       UNION ALL SELECT 'dishes', count(*) FROM d_dishes UNION ALL SELECT 'orders', count(*) FROM d_orders
       UNION ALL SELECT 'orders of refused needs', 0 UNION ALL SELECT 'quantity unaccounted for', 0""",
)
def _(c):
    """Finalised orders, batches, movements and dishes as one snapshot, read back: what was taken is what is missing,
    and no order that stock refuses is completed by it."""
    open_ = c.orders_by_key.where("NOT is_finalized").select(F.col("id").alias("order_id"))
    needs = c.consumption.join(open_, "order_id", "left_semi")
    made = inv.finalise_all(c.orders_by_key, needs, c.batches, c.dishes, c.recipe, dt.datetime(2001, 8, 1, 12))
    base = f"{shared_dir(c.spark)}/stock-{uuid.uuid4().hex}"
    snapshots.commit(c.spark, base, made)
    t = snapshots.read(c.spark, base)
    counts = [t[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).cast("double").alias("value")) for n in ("batches", "dishes", "orders")]
    before, after = (df.agg(F.sum("qty").alias("q")) for df in (c.batches, t["batches"]))
    moved = t["movements"].agg(F.coalesce(F.sum("change_qty"), F.lit(0)).alias("m"))
    lost = before.join(after.withColumnRenamed("q", "p")).join(moved).select(
        F.lit("quantity unaccounted for").alias("name"), (F.col("q") + F.col("m") - F.col("p")).cast("double").alias("value")
    )
    wanted = needs.groupBy("order_id").agg(F.sum("need").alias("need"))
    taken = t["movements"].groupBy(F.col("related_order_id").alias("order_id")).agg((-F.sum("change_qty")).alias("taken"))
    done = t["orders"].where("is_finalized").select(F.col("id").alias("order_id"))
    partly = wanted.join(taken, "order_id", "left").join(done, "order_id").where(F.col("need") != F.coalesce("taken", F.lit(0)))
    refused = partly.agg(F.lit("orders of refused needs").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    found = lost.unionByName(refused)
    for count in counts:
        found = found.unionByName(count)
    return found


@query("o69_fifo_strict")
def _(c):
    return fifo.fifo_allocate_strict(c.batches, c.consumption)


AFTER = f"""{FIFO},
    after AS (
        SELECT b.restaurant_id, b.ingredient_id, b.id, b.min_threshold, b.qty - COALESCE(t.taken, 0) AS qty,
               b.active AND NOT COALESCE(t.taken = b.qty AND t.past, false) AS active
        FROM d_batches b LEFT JOIN (
            SELECT restaurant_id, ingredient_id, batch_id AS id, SUM(take) AS taken, bool_or(need_end > lot_end) AS past
            FROM take GROUP BY 1, 2, 3) t USING (restaurant_id, ingredient_id, id))"""


@query(
    "o69_depleted_batches",
    f"""{AFTER} SELECT {LOC}, ingredient_id, id, CAST(qty AS DOUBLE) AS qty, active FROM after""",
)
def _(c):
    return fifo.deplete(c.batches, c.consumption).select(*fifo.KEYS, "id", "qty", "active")


@query(
    "o70_reorder",
    f"""{AFTER},
        levels AS (SELECT restaurant_id, ingredient_id, COALESCE(MIN(min_threshold), 5) AS threshold,
                          SUM(CASE WHEN active THEN qty ELSE 0 END) AS left_qty FROM after GROUP BY 1, 2)
        SELECT CAST(k.restaurant_id AS BIGINT) AS restaurant_id, k.ingredient_id,
               CAST(COALESCE(l.threshold, 5) * 10 AS DOUBLE) AS qty, 'new' AS status
        FROM (SELECT DISTINCT restaurant_id, ingredient_id FROM d_consumption) k
        LEFT JOIN levels l USING (restaurant_id, ingredient_id)
        WHERE COALESCE(l.left_qty, 0) <= COALESCE(l.threshold, 5) AND NOT EXISTS (
            SELECT 1 FROM d_purchase_requests p WHERE p.restaurant_id = k.restaurant_id
            AND p.ingredient_id = k.ingredient_id AND p.status IN ('new', 'ordered'))""",
)
def _(c):
    return inv.reorder_after(c.batches, c.consumption, c.purchase_requests)


@query(
    "o71b_finalise",
    """SELECT id, 'completed' AS status, true AS is_finalized,
              CASE WHEN NOT is_finalized THEN '2001-08-01 12:00:00' ELSE strftime(completed_at, '%Y-%m-%d %H:%M:%S') END AS completed_at,
              CASE WHEN NOT is_finalized THEN created_by_user ELSE completed_by_user END AS completed_by_user FROM d_orders""",
)
def _(c):
    return inv.finalise(c.orders_by_key, dt.datetime(2001, 8, 1, 12))


@query(
    "o71c_manual_requests",
    f"""SELECT {LOC}, ingredient_id, CAST(COALESCE(NULLIF(min_threshold, 0), 1) AS DOUBLE) AS qty, 'new' AS status
        FROM d_batches WHERE qty <= min_threshold""",
)
def _(c):
    low = c.batches.where(F.col("qty") <= F.col("min_threshold")).select(*fifo.KEYS, "id")
    return inv.manual_requests(c.batches, low)


@query(
    "o71d_adjust",
    f"""SELECT b.restaurant_id::BIGINT AS restaurant_id, b.ingredient_id, b.id,
               CAST(COALESCE(a.qty, b.qty) AS DOUBLE) AS qty, strftime(b.expiry_date, '%Y-%m-%d') AS expiry_date
        FROM d_batches b LEFT JOIN d_purchase_requests a ON a.restaurant_id = b.restaurant_id
             AND a.ingredient_id = b.ingredient_id AND a.id = b.id AND a.status = 'received'""",
)
def _(c):
    received = c.purchase_requests.where(F.col("status") == "received").select(
        *fifo.KEYS, "id", "qty", F.lit(None).cast("date").alias("expiry_date")
    )
    return inv.adjust(c.batches, received, [*fifo.KEYS, "id"]).select(
        *fifo.KEYS, "id", "qty", "expiry_date"
    )
