"""Statements of a query log, one per event, written the same way in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# (attack label, statement); {u} and {e} stand for the event's user and number.
STATEMENTS = (
    (0, "SELECT * FROM orders"),
    (0, "select id, name, price from dishes where restaurant_id = {u};"),
    (0, "SELECT name FROM dishes WHERE price > {u} ORDER BY price LIMIT 10"),
    (0, "select d.name, sum(i.qty)\n  from order_items i join dishes d on d.id = i.dish_id\n group by d.name"),
    (0, "WITH p AS (SELECT dish_id FROM order_items WHERE order_id = {e}) SELECT * FROM p"),
    (0, "explain select count(*) from orders where id = {e}"),
    (0, "SELECT created_at FROM orders WHERE status IN ('served', 'completed') AND id <> {e}"),
    (0, "SELECT o.id -- open ones\nFROM orders o JOIN restaurants r ON r.id = o.restaurant_id AND r.id = {u}"),
    (0, "select guest_name from reservations where note = 'please update {u}' and table_id in (1, 2)"),
    (0, "/* nightly */ SELECT restaurant_id, avg(total_amount) FROM orders GROUP BY restaurant_id HAVING count(*) > {u}"),
    (1, "SELECT * FROM dishes WHERE id = {u} OR 1=1 --"),
    (1, "SELECT * FROM dishes WHERE name = '{u}' UNION SELECT * FROM app_users"),
    (1, "SELECT id FROM dishes UNION ALL SELECT password_hash FROM app_users WHERE '{u}' = '{u}'"),
    (1, "SELECT * FROM dishes WHERE id = {u}; DROP TABLE dishes;"),
    (1, "SELECT * FROM dishes WHERE id = {u}; -- DROP TABLE orders"),
    (1, "SELECT * FROM orders WHERE id = {e} AND sleep({u}) = 0"),
    (1, "SELECT * FROM orders WHERE id = 0x{e} UNION SELECT 1, 2, 3 FROM app_roles WHERE 1 = 1"),
    (1, "DELETE FROM orders WHERE id = {e}"),
    (1, "update dishes set price = 0 where id = {u}"),
    (1, "SELECT x FROM dishes, orders WHERE x = {u} drop table suppliers"),
    (1, "SELECT table_name FROM information_schema.tables WHERE 1=1 UNION SELECT username FROM app_users"),
    (1, "SELECT * FROM dishes WHERE name = '{u}' AND (SELECT count(*) FROM app_users) > {e} OR 'a'='a' /* drop */"),
    (1, "SELECT ''''''''''''''''''''''''{u}, (x) FROM t, u"),
    (1, "-- nothing left {u}"),
)

# Hand-written filters to screen, and account names, and names of tables and columns.
PREDICATES = (
    "price > {u}",
    "status = 'served' AND id = {e}",
    "",
    "id IN (SELECT order_id FROM order_items WHERE qty > {u})",
    "pg_sleep({u}) IS NULL",
    "id = {e} UNION",
    "id = {e}; DROP TABLE orders",
    "name = 'x' drop table t",
    "a = '{u}' and (b = 2 or c = 'q''r''s''t''u''v''w''x')",
)

USERNAMES = (
    "waiter{u}",
    "",
    "admin' OR {u}=1",
    "a{u}--",
    "cook/*{u}",
    "x0123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890123456789{u}",
    "name with spaces {u}",
    "back\\slash{u}",
)

IDENTIFIERS = (
    ("orders", "o_custkey"),
    ("lineitem", "l_quantity"),
    ("orders", "no_such_{u}"),
    ("drop table", "o_custkey"),
    ("events", "1st"),
    ("part; --", "p_name"),
    ("nowhere_{u}", "p_name"),
)


def _filled(texts, key: str):
    column = F.element_at(
        F.array(*[F.lit(t) for t in texts]), (F.col(key) % len(texts)).cast("int") + 1
    )
    column = F.replace(column, F.lit("{u}"), F.col("user_id").cast("string"))
    return F.replace(column, F.lit("{e}"), F.col("event_id").cast("string"))


def _quoted(text: str) -> str:
    parts = [("'" + p.replace("'", "''") + "'") for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _filled_view(texts, key: str = "event_id") -> str:
    items = ", ".join(_quoted(t) for t in texts)
    base = f"list_extract([{items}], CAST({key} % {len(texts)} AS INT) + 1)"
    return (
        f"replace(replace({base}, '{{u}}', CAST(user_id AS VARCHAR)), '{{e}}', CAST(event_id AS VARCHAR))"
    )


def sql_text(events: DataFrame) -> DataFrame:
    """(log_id, sql, label, username, predicate, table_name, column_name) per event."""
    labels = F.array(*[F.lit(label) for label, _ in STATEMENTS])
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts"),
        _filled([s for _, s in STATEMENTS], "event_id").alias("sql"),
        F.element_at(labels, (F.col("event_id") % len(STATEMENTS)).cast("int") + 1).alias("label"),
        _filled(USERNAMES, "event_id").alias("username"),
        _filled(PREDICATES, "event_id").alias("predicate"),
        _filled([t for t, _ in IDENTIFIERS], "event_id").alias("table_name"),
        _filled([c for _, c in IDENTIFIERS], "event_id").alias("column_name"),
    )


def sql_text_view() -> str:
    labels = ", ".join(str(label) for label, _ in STATEMENTS)
    return f"""
        SELECT event_id AS log_id, ts, {_filled_view([s for _, s in STATEMENTS])} AS sql,
               list_extract([{labels}], CAST(event_id % {len(STATEMENTS)} AS INT) + 1) AS label,
               {_filled_view(USERNAMES)} AS username, {_filled_view(PREDICATES)} AS predicate,
               {_filled_view([t for t, _ in IDENTIFIERS])} AS table_name,
               {_filled_view([c for _, c in IDENTIFIERS])} AS column_name
        FROM events"""
