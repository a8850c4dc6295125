"""SQL definitions of the chain's tables over the star schema, for the oracle side."""

from tavola.functions.sqllog import sql_text_view

VIEWS = {
    "d_cities": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "d_restaurants": "SELECT n_nationkey AS id, n_regionkey AS city_id, n_name AS name FROM nation",
    "d_capacities": """
        SELECT r.id, r.city_id, r.name, COALESCE(k.cap, 10) AS max_concurrent_orders
        FROM d_restaurants r LEFT JOIN (
            SELECT c_nationkey AS id, CAST(floor(count(*) * 10 / 3.0) AS INT) AS cap
            FROM customer GROUP BY 1) k ON k.id = r.id""",
    "d_tables": """
        SELECT r.id * 5 + g.n - 1 AS id, r.id AS restaurant_id, 'T' || g.n AS table_number,
               CASE WHEN g.n <= 3 THEN 4 ELSE 6 END AS seats
        FROM d_restaurants r, (SELECT unnest([1, 2, 3, 4, 5]) AS n) g""",
    "d_dishes": """
        SELECT p_partkey AS id, CAST(p_partkey % 25 AS INT) AS restaurant_id, p_name AS name,
               p_type AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
               p_size AS prep_time_minutes, p_size > 5 AS is_available
        FROM part""",
    "d_orders": """
        SELECT o_orderkey AS id, c_nationkey AS restaurant_id,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN c_nationkey * 5 + o_orderkey % 5 END AS table_id,
               c_name AS guest_name, o_custkey AS created_by_user, o_orderdate AS order_time,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'served' WHEN 'O' THEN 'created' END AS status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, o_orderstatus = 'F' AS is_finalized,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR END AS completed_at,
               CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS completed_by_user
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "d_items": """
        SELECT l_orderkey AS order_id, l_partkey AS dish_id, CAST(l_quantity AS INT) AS qty,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price_at_order
        FROM lineitem""",
    "d_ingredients": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "d_recipe": """
        SELECT l_partkey AS dish_id, l_suppkey AS ingredient_id, CAST(count(*) AS DECIMAL(12,4)) AS qty_required
        FROM lineitem GROUP BY 1, 2""",
    "d_batches": """
        SELECT CAST(l_partkey % 25 AS INT) AS restaurant_id, l_suppkey AS ingredient_id, l_orderkey AS id,
               CAST(sum(CAST(l_quantity AS INT)) AS DECIMAL(12,4)) AS qty,
               CAST(max(CAST(l_shipdate AS DATE)) + 30 AS DATE) AS expiry_date,
               max(l_linestatus) = 'O' AS active,
               CAST(min(l_linenumber) * 10 AS DECIMAL(12,4)) AS min_threshold
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3""",
    "d_consumption": """
        SELECT CAST(l_partkey % 25 AS INT) AS restaurant_id, l_suppkey AS ingredient_id, l_orderkey AS order_id,
               CAST(sum(CAST(l_quantity AS INT)) AS DECIMAL(12,4)) AS need
        FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2, 3""",
    "d_purchase_requests": """
        SELECT restaurant_id, ingredient_id, id, qty, created_at,
               CASE WHEN discount = 0 THEN 'new' WHEN discount = 1 THEN 'ordered'
                    WHEN discount <= 5 THEN 'received' ELSE 'cancelled' END AS status
        FROM (SELECT CAST(l_partkey % 25 AS INT) AS restaurant_id, l_suppkey AS ingredient_id, l_orderkey AS id,
                     CAST(sum(CAST(l_quantity AS INT)) AS DECIMAL(12,4)) AS qty,
                     min(CAST(round(l_discount * 100) AS INT)) AS discount, max(l_shipdate) AS created_at
              FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3)""",
    "d_employees": "SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS position FROM customer",
    "d_accounts": """
        SELECT c_custkey AS id, c_nationkey AS restaurant_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'manager'
                    WHEN 'FURNITURE' THEN 'cook' WHEN 'AUTOMOBILE' THEN 'waiter' WHEN 'HOUSEHOLD' THEN 'analyst' END AS role,
               CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2
                    WHEN 'FURNITURE' THEN 3 WHEN 'AUTOMOBILE' THEN 4 WHEN 'HOUSEHOLD' THEN 5 END AS role_id
        FROM customer""",
    "d_users": "SELECT id, id AS employee_id, role || id AS username FROM d_accounts",
    "d_roles": "SELECT DISTINCT role_id AS id, role AS name FROM d_accounts",
    "d_user_roles": """
        SELECT id AS user_id, role_id, CASE WHEN role <> 'admin' THEN restaurant_id END AS restaurant_id
        FROM d_accounts""",
    "d_assignments": """
        SELECT o_orderkey AS id, o_custkey AS employee_id, CAST(o_orderkey % 25 AS INT) AS restaurant_id,
               o_orderdate AS assigned_from,
               CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 30 DAY
                                  WHEN 'O' THEN o_orderdate - INTERVAL 1 DAY END AS assigned_to
        FROM orders""",
    "d_order_log": """
        SELECT event_id AS id, CAST(user_id % 25 AS INT) AS restaurant_id, user_id AS created_by_user, ts AS order_time,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'served' WHEN 'click' THEN 'created'
                    WHEN 'signup' THEN 'preparing' WHEN 'error' THEN 'cancelled' END AS status
        FROM events""",
    "d_log_items": "SELECT event_id AS order_id, CAST(floor(value) AS INT) AS qty FROM events",
    "d_feedbacks": """
        SELECT event_id AS id, event_id AS order_id, CAST(floor(value) AS INT) % 7 AS rating FROM events""",
    "d_reservations": """
        SELECT event_id AS id, CAST(user_id % 25 AS INT) AS restaurant_id, ts AS reserved_from,
               ts + INTERVAL 2 HOUR AS reserved_to FROM events""",
    "d_movements": """
        SELECT restaurant_id, ingredient_id, order_id AS related_order_id, -need AS change_qty FROM d_consumption""",
    "d_sql_log": sql_text_view(),
}
