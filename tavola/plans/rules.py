"""Data quality, guarded writes, visibility and grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.functions.predicates import only
from tavola.operators import access, payloads, policyviews, quality as q
from tavola.operators.reports import orders_by_status
from tavola.plans.registry import query
from tavola.session import cut
from tavola.sources.tables import SCHEMAS

TABLES = sorted(SCHEMAS)


@query(
    "o110_one_city_only",
    """WITH a AS (SELECT a.*, r.city_id FROM d_assignments a JOIN d_restaurants r ON r.id = a.restaurant_id),
       f AS (SELECT *, first_value(city_id) OVER (PARTITION BY employee_id ORDER BY id) AS home FROM a)
       SELECT id, employee_id, CAST(restaurant_id AS BIGINT) AS restaurant_id FROM f WHERE city_id = home""",
)
def _(c):
    return q.one_city_only(c.assignments, c.restaurants).select("id", "employee_id", "restaurant_id")


@query(
    "o110_many_cities",
    """SELECT a.employee_id, count(DISTINCT r.city_id) AS cities FROM d_assignments a
       JOIN d_restaurants r ON r.id = a.restaurant_id GROUP BY 1 HAVING count(DISTINCT r.city_id) > 1""",
)
def _(c):
    return q.many_cities(c.assignments, c.restaurants)


@query(
    "o111_bad_intervals",
    "SELECT id, employee_id FROM d_assignments WHERE NOT (assigned_from <= COALESCE(assigned_to, 'infinity'::TIMESTAMP))",
)
def _(c):
    return q.bad_intervals(c.assignments, "assigned_from", "assigned_to").select("id", "employee_id")


@query(
    "o112_range_checks",
    """SELECT 'rating' AS rule, count(*) FILTER (WHERE NOT rating BETWEEN 1 AND 5) AS violations FROM d_feedbacks
       UNION ALL SELECT 'order given', count(*) FILTER (WHERE order_id IS NULL) FROM d_feedbacks
       UNION ALL SELECT 'qty', count(*) FILTER (WHERE NOT qty > 0) FROM d_items
       UNION ALL SELECT 'table given', count(*) FILTER (WHERE table_id IS NULL) FROM d_orders""",
)
def _(c):
    ratings = {"rating": F.col("rating").between(1, 5), "order given": q.not_null("order_id")}
    return (
        q.rule_report(c.feedbacks, ratings)
        .union(q.rule_report(c.items, {"qty": F.col("qty") > 0}))
        .union(q.rule_report(c.orders, {"table given": q.not_null("table_id")}))
    )


UNIQUE = {
    "order line": ("lineitem", "l_orderkey", "l_linenumber"),
    "part name": ("part", "p_name"),
    "account name": ("customer", "c_name"),
    "conversation turn": ("conversations", "conv_id", "turn"),
    "document text": ("documents", "text"),
}


@query(
    "o113_unique_keys",
    " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, count(*) AS keys, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS extra_rows FROM (
            SELECT count(*) AS n FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1)"""
        for rule, (table, *keys) in UNIQUE.items()
    ),
)
def _(c):
    return q.unique_report([(rule, c.raw(t), keys) for rule, (t, *keys) in UNIQUE.items()])


REFERENCES = {
    "item order": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "item dish": ("lineitem", "l_partkey", "part", "p_partkey"),
    "item ingredient": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "order account": ("orders", "o_custkey", "customer", "c_custkey"),
    "account location": ("customer", "c_nationkey", "nation", "n_nationkey"),
    "location city": ("nation", "n_regionkey", "region", "r_regionkey"),
    "feedback order": ("events", "event_id", "orders", "o_orderkey"),
    "label document": ("labels", "doc_id", "documents", "doc_id"),
    "document label": ("documents", "doc_id", "labels", "doc_id"),
}


@query(
    "o114_references",
    " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, count(DISTINCT {key}) AS keys, count(*) AS orphan_rows FROM {child} c
            WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key})"""
        for rule, (child, key, parent, parent_key) in REFERENCES.items()
    ),
)
def _(c):
    return q.reference_report(
        [(rule, c.raw(ch), k, c.raw(p), pk) for rule, (ch, k, p, pk) in REFERENCES.items()]
    )


@query(
    "o114_misplaced_tables",
    """SELECT o.id FROM (SELECT o_orderkey AS id, c_nationkey AS restaurant_id, o_orderkey % 125 AS table_id
                         FROM orders JOIN customer ON o_custkey = c_custkey) o
       JOIN d_tables t ON t.id = o.table_id WHERE t.restaurant_id <> o.restaurant_id""",
)
def _(c):
    seated = c.orders.withColumn("table_id", F.col("id") % 125)
    return q.misplaced_tables(seated, c.tables).select("id")


INCOMING = """SELECT o_custkey AS user_id, CASE WHEN o_totalprice > 400000 THEN 4 ELSE 5 END AS role_id,
                     CAST(o_custkey % 25 AS INT) AS restaurant_id FROM orders"""


def _incoming(c):
    return c.raw("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_totalprice") > 400000, 4).otherwise(5).alias("role_id"),
        (F.col("o_custkey") % 25).cast("int").alias("restaurant_id"),
    )


MERGED = f"""SELECT user_id, role_id, restaurant_id FROM d_user_roles UNION ALL
             SELECT DISTINCT i.user_id, i.role_id, i.restaurant_id FROM ({INCOMING}) i
             WHERE NOT EXISTS (SELECT 1 FROM d_user_roles u WHERE u.user_id = i.user_id AND u.role_id = i.role_id)"""


@query(
    "o115_insert_or_ignore",
    f"""SELECT user_id, CAST(role_id AS BIGINT) AS role_id, CAST(restaurant_id AS BIGINT) AS restaurant_id
        FROM ({MERGED})""",
)
def _(c):
    return q.insert_or_ignore(c.user_roles, _incoming(c), ["user_id", "role_id"])


@query(
    "o116_json_rows",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS note,
              'k' AS unknown, true AS is_object FROM events""",
)
def _(c):
    events = c.raw("events").select("event_id", "props")
    rows = q.parse_rows(events, "props", "k bigint, note string", ["id", "note"])
    return rows.select("event_id", "k", "note", F.array_join("unknown_keys", ",").alias("unknown"), "is_object")


@query(
    "o117_ingest_orders",
    """SELECT o.id, CAST(o.restaurant_id AS BIGINT) AS restaurant_id, CAST(t.id AS BIGINT) AS table_id,
              CASE WHEN o.status = 'served' THEN 'created' ELSE o.status END AS status,
              CASE WHEN o.is_finalized THEN 0 ELSE CAST(o.total_amount AS DOUBLE) END AS total_amount
       FROM d_orders o LEFT JOIN d_tables t ON t.restaurant_id = o.restaurant_id
            AND t.table_number = 'T' || (o.id % 7 + 1)""",
)
def _(c):
    incoming = c.orders.select(
        "id",
        "restaurant_id",
        F.concat(F.lit("T"), (F.col("id") % 7 + 1).cast("string")).alias("table_number"),
        F.when(F.col("status") != "served", F.col("status")).alias("status"),
        F.when(~F.col("is_finalized"), F.col("total_amount").cast("string")).alias("total"),
    )
    return q.ingest_orders(incoming, c.tables)


@query(
    "o117_ingest_items",
    """SELECT CAST(order_id AS BIGINT) AS order_id, dish_id, CAST(qty AS BIGINT) AS qty,
              CAST(price_at_order AS DOUBLE) AS price_at_order FROM d_items""",
)
def _(c):
    text = c.items.select(*[F.col(x).cast("string") for x in ("order_id", "dish_id", "qty")],
                          F.col("price_at_order").cast("string").alias("price"))
    return q.ingest_items(text)


@query(
    "o118_set_by_name",
    """SELECT id, CAST(CASE category WHEN 'ECONOMY' THEN 8 WHEN 'PROMO' THEN 25 ELSE prep_time_minutes END AS BIGINT)
              AS prep_time_minutes FROM d_dishes""",
)
def _(c):
    values = {"ECONOMY": 8, "PROMO": 25}
    return q.set_by_name(c.dishes, "category", "prep_time_minutes", values).select("id", "prep_time_minutes")


PREFIXES = ["manager", "cook", "waiter"]


@query(
    "o119_roles_by_prefix",
    """SELECT u.id AS user_id, CAST(r.id AS BIGINT) AS role_id, CAST(a.restaurant_id AS BIGINT) AS restaurant_id
       FROM d_users u JOIN d_employees e ON u.employee_id = e.id JOIN d_assignments a ON a.employee_id = e.id
       JOIN d_roles r ON u.username LIKE r.name || '%' WHERE r.name IN ('manager', 'cook', 'waiter')""",
)
def _(c):
    return q.roles_by_prefix(c.users, c.assignments, c.roles, PREFIXES)


# Visibility --------------------------------------------------------------------------------

VIEWERS = """SELECT a.user_id, r.name AS role, a.restaurant_id FROM d_user_roles a JOIN d_roles r ON r.id = a.role_id"""


def viewers(c):
    named = c.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return c.user_roles.join(named, "role_id").select("user_id", "role", "restaurant_id")


def _visible(source: str, own: str, wide: str = "'admin', 'analyst'") -> str:
    return f"""
        WITH v AS ({VIEWERS}), p AS (SELECT restaurant_id, count(*) AS n FROM ({source}) GROUP BY 1)
        SELECT v.user_id, CAST(CASE WHEN v.role IN ({wide}) THEN (SELECT COALESCE(SUM(n), 0) FROM p)
                                    WHEN v.role IN ({own}) THEN COALESCE(p.n, 0) ELSE 0 END AS BIGINT) AS visible_rows
        FROM v LEFT JOIN p ON p.restaurant_id = v.restaurant_id"""


_OWN = {
    "orders": ("o120_visible_orders", "SELECT * FROM d_orders", "'manager', 'waiter', 'cook'"),
    "ingredient_batches": ("o120_visible_batches", "SELECT * FROM d_batches", "'manager', 'cook'"),
    "dishes": ("o120_visible_dishes", "SELECT * FROM d_dishes", "'manager', 'cook', 'waiter'"),
    "purchase_requests": ("o120_visible_requests", "SELECT * FROM d_purchase_requests", "'manager', 'cook'"),
    "inventory_movements": ("o120_visible_movements", "SELECT * FROM d_movements", "'manager', 'cook'"),
    "reservations": ("o120_visible_reservations", "SELECT * FROM d_reservations", "'manager', 'waiter'"),
}
_ATTRIBUTES = {"ingredient_batches": "batches", "inventory_movements": "movements"}


def _register_own(table: str) -> None:
    name, source, own = _OWN[table]

    @query(name, _visible(source, own))
    def _(c):
        return access.visible_counts(getattr(c, _ATTRIBUTES.get(table, table)), table, viewers(c))


for _table in _OWN:
    _register_own(_table)


@query(
    "o121_visible_items",
    _visible(
        "SELECT o.restaurant_id FROM d_items i JOIN d_orders o ON o.id = i.order_id", "'manager', 'waiter', 'cook'"
    ),
)
def _(c):
    return access.visible_counts(access.via_orders(c.items, c.orders), "order_items", viewers(c))


@query(
    "o121_visible_feedbacks",
    _visible("SELECT o.restaurant_id FROM d_feedbacks f JOIN d_orders o ON o.id = f.order_id", "'manager'"),
)
def _(c):
    return access.visible_counts(access.via_orders(c.feedbacks, c.orders), "feedbacks", viewers(c))


@query(
    "o121_visible_employees",
    _visible("SELECT DISTINCT employee_id, restaurant_id FROM d_assignments", "'manager'", "'admin'").replace(
        "(SELECT COALESCE(SUM(n), 0) FROM p)", "(SELECT count(*) FROM d_employees)"
    ),
)
def _(c):
    per_place = c.assignments.select("employee_id", "restaurant_id").distinct()
    who = viewers(c)
    seen = access.visible_counts(per_place, "employees", who.where(F.col("role") != "admin"))
    everyone = only(c.employees, F.count(F.lit(1))).alias("visible_rows")
    return seen.unionByName(who.where(F.col("role") == "admin").select("user_id", everyone))


@query(
    "o120_row_filter_manager",
    """SELECT status, count(*) AS cnt FROM d_orders WHERE restaurant_id = 3 GROUP BY 1""",
)
def _(c):
    return orders_by_status(access.row_filter(c.orders, "orders", "manager", 3))


@query(
    "o122_grant_report",
    f"""WITH v AS ({VIEWERS}), g(role, verb, table_name) AS (VALUES {', '.join(
        f"('{r}', '{v}', '{t}')" for r, v, t, _ in access.grant_rows(TABLES))})
        SELECT g.table_name, g.verb, count(*) AS accounts FROM v JOIN g ON g.role = v.role GROUP BY 1, 2""",
)
def _(c):
    return access.grant_report(viewers(c), access.grant_matrix(c.spark, TABLES))


@query(
    "o122_module_report",
    f"""WITH v AS ({VIEWERS}), m(role, module) AS (VALUES {', '.join(
        f"('{r}', '{m}')" for r, names in access.MODULES.items() for m in names)})
        SELECT m.module, count(*) AS accounts FROM v JOIN m ON m.role = v.role GROUP BY 1""",
)
def _(c):
    joined = viewers(c).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return (
        joined.join(access.module_matrix(c.spark), "role")
        .groupBy("module")
        .agg(F.sum("n").alias("accounts"))
    )


@query(
    "o123_item_inserts",
    f"""WITH v AS ({VIEWERS})
        SELECT i.l_orderkey AS order_id, i.l_suppkey AS user_id,
               COALESCE(v.role = 'admin' OR (v.role IN ('manager', 'waiter') AND v.restaurant_id = o.restaurant_id), false)
               AS accepted
        FROM lineitem i LEFT JOIN d_orders o ON o.id = i.l_orderkey LEFT JOIN v ON v.user_id = i.l_suppkey""",
)
def _(c):
    proposed = c.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("user_id"))
    return access.check_item_inserts(proposed, c.orders, viewers(c))


PRIMARY = f"""SELECT user_id, role, restaurant_id FROM (
    SELECT m.user_id, r.name AS role, m.restaurant_id, row_number() OVER (PARTITION BY m.user_id ORDER BY r.name) AS n
    FROM ({MERGED}) m JOIN d_roles r ON r.id = m.role_id) WHERE n = 1"""


def _primary(c):
    merged = q.insert_or_ignore(c.user_roles, _incoming(c), ["user_id", "role_id"])
    return access.primary_roles(merged, c.roles)


@query(
    "o124_primary_roles",
    f"SELECT user_id, role, CAST(restaurant_id AS BIGINT) AS restaurant_id FROM ({PRIMARY})",
)
def _(c):
    return _primary(c)


@query(
    "o124_scoped_counts",
    f"""WITH v AS ({PRIMARY}), p AS (SELECT restaurant_id, count(*) AS n FROM d_orders GROUP BY 1)
        SELECT v.user_id, CAST(CASE WHEN v.role <> 'admin' AND v.restaurant_id IS NOT NULL THEN COALESCE(p.n, 0)
                               ELSE (SELECT SUM(n) FROM p) END AS BIGINT) AS rows_seen
        FROM v LEFT JOIN p ON p.restaurant_id = v.restaurant_id""",
)
def _(c):
    return access.scoped_counts(c.orders, _primary(c))


def _filtered(source: str, link: str) -> str:
    return f"SELECT {link}, count(*) AS cnt FROM {source} GROUP BY 1"


@query(
    "o121_row_filter_items",
    _filtered("d_items WHERE order_id IN (SELECT id FROM d_orders WHERE restaurant_id = 3)", "order_id"),
)
def _(c):
    seen = access.row_filter(c.items, "order_items", "waiter", 3, orders=c.orders)
    return seen.groupBy("order_id").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "o121_row_filter_feedbacks",
    _filtered("d_feedbacks WHERE order_id IN (SELECT id FROM d_orders WHERE restaurant_id = 3)", "order_id"),
)
def _(c):
    seen = access.row_filter(c.feedbacks, "feedbacks", "manager", 3, orders=c.orders)
    return seen.groupBy("order_id").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "o121_row_filter_employees",
    "SELECT id, full_name FROM d_employees WHERE id IN (SELECT employee_id FROM d_assignments WHERE restaurant_id = 3)",
)
def _(c):
    return access.row_filter(c.employees, "employees", "manager", 3, assignments=c.assignments).select("id", "full_name")


# Names per location, as a seed script lists them.
NAMED = {1: ["Customer#000000001", "Customer#000000004"], 2: ["Customer#000000002"], 5: ["Customer#000000003", "Nobody"]}


@query(
    "o119_assigned_by_name",
    "SELECT id AS employee_id, CAST(CASE " + " ".join(
        f"WHEN full_name IN ({', '.join(repr(n) for n in names)}) THEN {place}" for place, names in NAMED.items()
    ) + " END AS BIGINT) AS restaurant_id FROM d_employees WHERE full_name IN (" + ", ".join(
        repr(n) for names in NAMED.values() for n in names
    ) + ")",
)
def _(c):
    return q.assign_by_name(c.employees, "full_name", NAMED)


VIEW_ROLES = ("admin", "analyst", "manager", "waiter", "cook", "nobody")


@query(
    "o120_policy_views",
    "WITH i AS (SELECT o.restaurant_id, count(*) AS n FROM d_items i JOIN d_orders o ON o.id = i.order_id GROUP BY 1), "
    "f AS (SELECT o.restaurant_id, count(*) AS n FROM d_feedbacks f JOIN d_orders o ON o.id = f.order_id GROUP BY 1) "
    + " UNION ALL ".join(
        f"SELECT '{role}' AS role, CAST(COALESCE((SELECT SUM(n) FROM i{w_items}), 0) AS BIGINT) AS items,"
        f" CAST(COALESCE((SELECT SUM(n) FROM f{w_feed}), 0) AS BIGINT) AS feedbacks,"
        f" (SELECT count(*) FROM d_orders{w_orders}) AS orders"
        for role, w_items, w_feed, w_orders in [
            *[(r, "", "", "") for r in ("admin", "analyst")],
            ("manager", *[" WHERE restaurant_id = 3"] * 3),
            *[(r, " WHERE restaurant_id = 3", " WHERE false", " WHERE restaurant_id = 3") for r in ("waiter", "cook")],
            ("nobody", *[" WHERE false"] * 3),
        ]
    ),
)
def _(c):
    """The same statement over the views, for one viewer after the other."""
    policyviews.define(c.spark, {"orders": c.orders, "order_items": c.items, "feedbacks": c.feedbacks})
    seen = None
    for role in VIEW_ROLES:
        policyviews.become(c.spark, role, 3)
        rows = cut(c.spark.sql(
            f"""SELECT '{role}' AS role, (SELECT count(*) FROM visible_order_items) AS items,
                       (SELECT count(*) FROM visible_feedbacks) AS feedbacks, (SELECT count(*) FROM visible_orders) AS orders"""
        ))
        seen = rows if seen is None else seen.unionByName(rows)
    policyviews.become(c.spark, None)
    return seen


PAYLOAD = {"id": "bigint", "guest.name": "string", "guest.seats": "int", "place.at": "bigint"}


@query(
    "o116_nested_payloads",
    """SELECT o_orderkey AS id,
              CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'guest ' || o_custkey END AS guest_name,
              CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS BIGINT) END AS guest_seats,
              CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 25 END AS place_at,
              CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'guest.note' END
                  || CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',' END || 'remark' ELSE '' END AS unknown,
              CASE WHEN o_orderkey % 5 = 0 THEN 'guest' WHEN o_orderkey % 3 = 0 THEN 'guest.seats' ELSE '' END AS ill
       FROM orders""",
)
def _(c):
    """Orders as nested payloads: some guests are no object, some seats no number, some fields not declared."""
    k, text = F.col("o_orderkey"), lambda column: F.col(column).cast("string")
    seats = F.when(k % 3 == 0, F.lit('"few"')).otherwise((F.col("o_custkey") % 9).cast("string"))
    guest = F.concat(F.lit('{"name":"guest '), text("o_custkey"), F.lit('","note":[1],"seats":'), seats, F.lit("}"))
    body = F.concat(
        F.lit('{"id":'), text("o_orderkey"), F.lit(',"guest":'), F.when(k % 5 == 0, F.lit("17")).otherwise(guest),
        F.when(k % 7 == 0, F.lit(',"place":{"at":null}')).otherwise(F.concat(F.lit(',"place":{"at":'), (k % 25).cast("string"), F.lit("}"))),
        F.when(k % 2 == 0, F.lit(',"remark":"x"')).otherwise(""),
        F.lit("}"),
    )
    made = payloads.typed_payload(c.raw("orders").select(body.alias("body")), "body", PAYLOAD)
    return made.select(
        "id", "guest_name", "guest_seats", "place_at", F.array_join("unknown_paths", ",").alias("unknown"), F.array_join("ill_typed", ",").alias("ill")
    )
