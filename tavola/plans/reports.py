"""Scans, listings, joins and aggregate reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tavola.functions.formatting import format_datetimes
from tavola.functions.predicates import SOLD, equals, only, where_all
from tavola.functions.stemming import has_all_stems
from tavola.operators import listing, reports as rep, wordindex
from tavola.plans.registry import query
from tavola.sources import corpus
from tavola.sources.tables import catalog_of, row_counts

AS_OF = dt.date(2001, 8, 1)

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SOLD_SQL = "o.status IN ('completed', 'served')"


@query(
    "o01_table_scan",
    "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in RAW_TABLES),
)
def _(c):
    return row_counts({t: c.raw(t) for t in RAW_TABLES})


@query(
    "o02_browse",
    """SELECT id, created_by_user, CAST(total_amount AS DOUBLE) AS total_amount, status FROM d_orders
       WHERE total_amount > 250000 ORDER BY id LIMIT 5000""",
)
def _(c):
    wanted = c.orders_by_key.select("id", "created_by_user", "total_amount", "status")
    return listing.browse(wanted, "total_amount > 250000", 5000)


@query("o03_corpus_clean", "SELECT DISTINCT sql AS query, CAST(label AS BIGINT) AS label FROM d_sql_log")
def _(c):
    return corpus.clean_corpus(c.sql_log.select("sql", "label"))


@query(
    "o04_export_tables",
    """SELECT 'ingredients' AS table_name, count(*) AS rows, CAST(SUM(length(CAST(id AS VARCHAR)) + length(name)) AS BIGINT) AS chars FROM d_ingredients
       UNION ALL
       SELECT 'restaurants', count(*), CAST(SUM(length(CAST(id AS VARCHAR)) + length(CAST(city_id AS VARCHAR)) + length(name)) AS BIGINT) FROM d_restaurants""",
)
def _(c):
    tables = {
        "ingredients": c.ingredients, "restaurants": c.restaurants,
        "app_user_roles": c.user_roles, "purchase_requests": c.purchase_requests,
    }
    made = None
    for name, df in corpus.exported(tables).items():
        length = F.length(F.concat(*df.columns))
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(length).alias("chars"))
        made = row if made is None else made.unionByName(row)
    return made


@query(
    "o06_catalog",
    """SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS position FROM information_schema.columns
       WHERE table_name IN ('region', 'nation', 'supplier', 'lineitem')""",
)
def _(c):
    named = {n: c.raw(n) for n in ("region", "nation", "supplier", "lineitem")}
    return catalog_of(c.spark, named).select("table_name", "column_name", "position")


TOP_COMPLETED = """
    SELECT r.name AS restaurant, d.name AS dish, CAST(SUM(i.qty) AS BIGINT) AS total
    FROM d_items i JOIN d_dishes d ON i.dish_id = d.id JOIN d_orders o ON i.order_id = o.id
    JOIN d_restaurants r ON o.restaurant_id = r.id
    WHERE o.status = 'completed' GROUP BY 1, 2 ORDER BY total DESC, 1, 2 LIMIT 20"""


@query("o33_top_completed_dishes", TOP_COMPLETED)
def top_completed(c):
    return rep.top_completed_dishes(c.items, c.orders, c.dishes, c.restaurants)


@query(
    "o05_report_headers",
    f"""SELECT restaurant AS "Ресторан", dish AS "Блюдо", total AS "Продано" FROM ({TOP_COMPLETED.strip()})""",
)
def _(c):
    return corpus.report_headers(top_completed(c))


@query(
    "o07_format_datetimes",
    """SELECT id, strftime(assigned_from, '%Y-%m-%d %H:%M:%S') AS assigned_from,
              strftime(assigned_to, '%Y-%m-%d %H:%M:%S') AS assigned_to,
              strftime(CAST(assigned_from AS DATE), '%Y-%m-%d') AS day FROM d_assignments""",
)
def _(c):
    rows = c.assignments.select(
        "id", "assigned_from", "assigned_to", F.to_date("assigned_from").alias("day")
    )
    return format_datetimes(rows)


# Filters and listings ----------------------------------------------------------------------

MENU_COLUMNS = """id, CAST(restaurant_id AS BIGINT) AS restaurant_id, name, category,
    CAST(price AS DOUBLE) AS price, CAST(prep_time_minutes AS BIGINT) AS prep_time_minutes, is_available"""


@query(
    "o10_optional_filters",
    """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, count(*) AS orders_count,
              CAST(sum(total_amount) AS DOUBLE) AS total_amount
       FROM d_orders WHERE status = 'served' AND total_amount >= 1000 GROUP BY 1""",
)
def _(c):
    large = F.col("total_amount") >= 1000
    return rep.orders_per_location(where_all(c.orders, equals("status", "served"), None, large))


@query(
    "o11_menu_filter",
    f"""SELECT {MENU_COLUMNS} FROM d_dishes
        WHERE lower(category) = 'promo' AND is_available AND price >= 905.5 AND price <= 999
          AND contains(lower(name), 'ring') ORDER BY d_dishes.restaurant_id, name, id LIMIT 200""",
)
def _(c):
    return listing.menu(
        c.dishes, category="Promo", is_available=True, price_min=905.5, price_max=999, keyword="RING"
    )


@query(
    "o12_orders_list",
    """SELECT o.id, CAST(o.restaurant_id AS BIGINT) AS restaurant_id, t.table_number, o.guest_name, o.status,
              strftime(o.order_time, '%Y-%m-%d %H:%M:%S') AS created_at, CAST(o.total_amount AS DOUBLE) AS total_amount
       FROM d_orders o LEFT JOIN d_tables t ON t.id = o.table_id
       WHERE o.status = 'served' ORDER BY o.order_time DESC, o.id LIMIT 300""",
)
def _(c):
    return listing.orders_list(c.orders, c.tables, status="served")


@query(
    "o13_stock_list",
    """SELECT s.id, CAST(s.restaurant_id AS BIGINT) AS restaurant_id, s.ingredient_id, i.name AS ingredient_name,
              CAST(s.qty AS DOUBLE) AS qty, strftime(s.expiry_date, '%Y-%m-%d') AS expiry_date,
              CAST(s.min_threshold AS DOUBLE) AS min_threshold
       FROM d_batches s JOIN d_ingredients i ON i.id = s.ingredient_id""",
)
def _(c):
    return listing.stock_list(c.batches, c.ingredients)


@query(
    "o14_request_list",
    """SELECT p.id, CAST(p.restaurant_id AS BIGINT) AS restaurant_id, i.name AS ingredient_name,
              CAST(p.qty AS DOUBLE) AS qty, p.status, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
       FROM d_purchase_requests p JOIN d_ingredients i ON i.id = p.ingredient_id""",
)
def _(c):
    return listing.request_list(c.purchase_requests, c.ingredients)


@query(
    "o15_unavailable_dishes",
    """SELECT r.name AS restaurant, d.name AS dish FROM d_dishes d
       JOIN d_restaurants r ON d.restaurant_id = r.id WHERE NOT d.is_available""",
)
def _(c):
    return listing.unavailable_dishes(c.dishes, c.restaurants)


@query("o16_public_roles", "SELECT name FROM d_roles WHERE name <> 'admin'")
def _(c):
    return listing.public_roles(c.roles)


@query(
    "o18_evening_orders",
    """SELECT id, CAST(restaurant_id AS BIGINT) AS restaurant_id, CAST(hour(order_time) AS BIGINT) AS hour_of_day
       FROM d_order_log WHERE hour(order_time) BETWEEN 18 AND 20""",
)
def _(c):
    hour = F.hour("order_time")
    return c.order_log.where(hour.between(18, 20)).select("id", "restaurant_id", hour.alias("hour_of_day"))


@query(
    "o24_keyword_search",
    r"""SELECT doc_id, lang FROM documents
        WHERE list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['the', 'that'])""",
)
def _(c):
    docs = c.raw("documents").select("doc_id", "lang", "text")
    return listing.search_texts(docs, "text", "That, THE").drop("text")


@query(
    "o24_menu_words",
    f"""SELECT {MENU_COLUMNS} FROM d_dishes
        WHERE list_has_all(string_split_regex(lower(name), '[^a-z0-9]+'), ['ring', 'small'])
        ORDER BY d_dishes.restaurant_id, name, id LIMIT 200""",
)
def _(c):
    return listing.menu(c.dishes, words="ring small")


# The stems of words of Latin letters, step by step, and the texts with forms of both words.
STEMMED_SQL = r"""
    WITH words AS (
        SELECT doc_id, lang, unnest(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+'))) AS w FROM documents),
    plural AS (
        SELECT doc_id, lang, w, CASE
            WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
            WHEN length(w) > 4 AND (w LIKE '%ies' OR w LIKE '%ied') THEN left(w, length(w) - 2)
            WHEN length(w) = 4 AND (w LIKE '%ies' OR w LIKE '%ied') THEN left(w, length(w) - 1)
            WHEN w LIKE '%s' AND right(w, 2) NOT IN ('ss', 'us') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]')
            THEN left(w, length(w) - 1) ELSE w END AS p
        FROM words WHERE regexp_full_match(w, '[a-z]+')),
    verb AS (
        SELECT doc_id, lang, w, p, regexp_replace(p, '(ed|ing)(ly)?$', '') AS cut, regexp_matches(p, 'eed(ly)?$') AS eed
        FROM plural),
    filled AS (
        SELECT doc_id, lang, w, CASE
            WHEN eed AND regexp_matches(p, '[aeiouy][^aeiouy].*eed(ly)?$') THEN regexp_replace(p, 'd(ly)?$', '')
            WHEN eed OR cut = p OR NOT regexp_matches(cut, '[aeiouy]') THEN p
            WHEN right(cut, 2) IN ('at', 'bl', 'iz') THEN cut || 'e'
            WHEN right(cut, 2) IN ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') THEN left(cut, length(cut) - 1)
            WHEN regexp_full_match(cut, '[^aeiouy]*[aeiouy][^aeiouywx]') THEN cut || 'e' ELSE cut END AS v
        FROM verb),
    stems AS (
        SELECT DISTINCT doc_id, lang, CASE WHEN length(w) <= 2 THEN w
            WHEN regexp_matches(v, '^.+[^aeiouy]y$') THEN left(v, length(v) - 1) || 'i' ELSE v END AS stem
        FROM filled)
    SELECT doc_id, lang FROM stems WHERE stem IN ('one', 'onli') GROUP BY 1, 2 HAVING count(*) = 2"""


@query("o24_stemmed_search", STEMMED_SQL)
def _(c):
    docs = c.raw("documents").select("doc_id", "lang", "text")
    return docs.where(has_all_stems("text", "Ones; ONLY")).drop("text")


@query("o24_indexed_search", STEMMED_SQL)
def _(c):
    docs = c.raw("documents").select("doc_id", "lang", "text")
    index = wordindex.build_index(docs, "doc_id", "text")
    return wordindex.search_index(docs.drop("text"), "doc_id", index, "Ones; ONLY")


# Joins -------------------------------------------------------------------------------------


@query(
    "o20_inner_chain",
    """SELECT ci.name AS city, d.category, CAST(count(*) AS BIGINT) AS lines
       FROM d_items i JOIN d_dishes d ON i.dish_id = d.id JOIN d_orders o ON i.order_id = o.id
       JOIN d_restaurants r ON o.restaurant_id = r.id JOIN d_cities ci ON r.city_id = ci.id GROUP BY 1, 2""",
)
def _(c):
    places = c.restaurants.join(
        c.cities.select(F.col("id").alias("city_id"), F.col("name").alias("city")), "city_id"
    ).select(F.col("id").alias("restaurant_id"), "city")
    return (
        c.items.join(c.orders.select(F.col("id").alias("order_id"), "restaurant_id"), "order_id")
        .join(c.dishes.select(F.col("id").alias("dish_id"), "category"), "dish_id")
        .join(places, "restaurant_id")
        .groupBy("city", "category")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "o21_left_join",
    """SELECT d.lang, CAST(count(*) AS BIGINT) AS docs, CAST(count(l.quality) AS BIGINT) AS labelled
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def _(c):
    return (
        c.raw("documents").select("doc_id", "lang")
        .join(c.raw("labels"), "doc_id", "left")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("docs"), F.count("quality").alias("labelled"))
    )


@query(
    "o22_never_ordered",
    """SELECT r.name AS restaurant, d.name AS dish FROM d_dishes d JOIN d_restaurants r ON d.restaurant_id = r.id
       LEFT JOIN (SELECT i.dish_id FROM d_items i JOIN d_orders o ON i.order_id = o.id
                  WHERE o.order_time >= TIMESTAMP '2000-08-01') i ON d.id = i.dish_id
       WHERE i.dish_id IS NULL""",
)
def _(c):
    recent = c.orders_by_key.where(F.col("order_time") >= F.lit("2000-08-01").cast("timestamp_ntz"))
    items = c.items.join(recent.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return rep.never_ordered(c.dishes, items, c.restaurants)


@query(
    "o22_unlabelled",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL""",
)
def _(c):
    return c.raw("documents").select("doc_id").join(c.raw("labels"), "doc_id", "left_anti")


@query(
    "o25_semi_join",
    """SELECT o.status, CAST(count(*) AS BIGINT) AS cnt FROM d_orders o
       WHERE EXISTS (SELECT 1 FROM d_items i WHERE i.order_id = o.id AND i.qty >= 50) GROUP BY 1""",
)
def _(c):
    large = c.items.where(F.col("qty") >= 50).select(F.col("order_id").alias("id"))
    return rep.orders_by_status(c.orders_by_key.join(large, "id", "left_semi"))


@query(
    "o26_scalar_subquery",
    """SELECT id, name FROM d_dishes WHERE price > (SELECT avg(CAST(price AS DOUBLE)) FROM d_dishes)""",
)
def _(c):
    return c.dishes.where(F.col("price") > only(c.dishes, F.avg("price"))).select("id", "name")


@query(
    "o28_usage_in_popular",
    f"""WITH pop AS (SELECT i.dish_id AS id FROM d_items i JOIN d_orders o ON i.order_id = o.id WHERE {SOLD_SQL}
                     GROUP BY 1 ORDER BY SUM(i.qty) DESC, 1 LIMIT 10)
        SELECT g.name AS ingredient, CAST(SUM(rc.qty_required * i.qty) AS DOUBLE) AS total_used
        FROM d_items i JOIN d_recipe rc ON i.dish_id = rc.dish_id JOIN d_ingredients g ON rc.ingredient_id = g.id
        JOIN d_orders o ON i.order_id = o.id JOIN pop ON i.dish_id = pop.id WHERE {SOLD_SQL} GROUP BY 1""",
)
def _(c):
    popular = rep.popular_dishes(c.items, c.orders_by_key)
    return rep.ingredient_usage(c.items, c.recipe, c.ingredients, c.orders_by_key, dishes=popular)


@query(
    "o29_table_grid",
    """SELECT s.s_suppkey AS restaurant_id, 'T' || g.n AS table_number,
              CAST(CASE WHEN g.n <= 3 THEN 4 ELSE 6 END AS BIGINT) AS seats
       FROM supplier s, (SELECT unnest([1, 2, 3, 4, 5]) AS n) g""",
)
def _(c):
    number = F.explode(F.sequence(F.lit(1), F.lit(5)))
    return c.sites.select(F.col("id").alias("restaurant_id"), number.alias("n")).select(
        "restaurant_id",
        F.concat(F.lit("T"), F.col("n").cast("string")).alias("table_number"),
        F.when(F.col("n") <= 3, 4).otherwise(6).alias("seats"),
    )


# Aggregations ------------------------------------------------------------------------------


@query(
    "o30_counts",
    """SELECT (SELECT count(*) FROM d_orders) AS orders, (SELECT count(*) FROM d_batches) AS stocks,
              (SELECT count(*) FROM d_dishes) AS dishes""",
)
def _(c):
    return row_counts({"orders": c.orders_by_key, "stocks": c.batches, "dishes": c.dishes})


@query(
    "o31_orders_per_location",
    """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, count(*) AS orders_count,
              CAST(sum(total_amount) AS DOUBLE) AS total_amount FROM d_orders GROUP BY 1""",
)
def _(c):
    return rep.orders_per_location(c.orders)


@query(
    "o32_top_dishes",
    """SELECT CAST(d.restaurant_id AS BIGINT) AS restaurant_id, d.name, CAST(SUM(i.qty) AS BIGINT) AS total_qty
       FROM d_items i JOIN d_dishes d ON d.id = i.dish_id GROUP BY 1, 2 ORDER BY total_qty DESC, 1, 2 LIMIT 20""",
)
def _(c):
    return rep.top_dishes_by_home(c.items, c.dishes)


@query(
    "o34_low_stock",
    """SELECT CAST(s.restaurant_id AS BIGINT) AS restaurant_id, i.name, CAST(s.qty AS DOUBLE) AS qty,
              CAST(s.min_threshold AS DOUBLE) AS min_threshold
       FROM d_batches s JOIN d_ingredients i ON i.id = s.ingredient_id WHERE s.qty <= s.min_threshold""",
)
def _(c):
    return rep.low_stock(c.batches, c.ingredients)


@query(
    "o35_expiring",
    """SELECT CAST(s.restaurant_id AS BIGINT) AS restaurant_id, i.name, CAST(s.qty AS DOUBLE) AS qty,
              strftime(s.expiry_date, '%Y-%m-%d') AS expiry_date
       FROM d_batches s JOIN d_ingredients i ON i.id = s.ingredient_id
       WHERE s.expiry_date IS NOT NULL AND s.expiry_date <= DATE '2001-08-01' + INTERVAL 7 DAY""",
)
def _(c):
    return rep.expiring(c.batches, c.ingredients, AS_OF)


@query("o36_orders_by_status", "SELECT status, count(*) AS cnt FROM d_orders GROUP BY status")
def _(c):
    return rep.orders_by_status(c.orders_by_key)


SUMMARY = """
    SELECT CAST(r.id AS BIGINT) AS restaurant_id, r.name AS restaurant_name,
           COALESCE(o.n, 0) AS orders_count, COALESCE(CAST(o.s{om} AS DOUBLE), 0) AS orders_sum,
           COALESCE(b.n, 0) AS stocks_count, COALESCE(CAST(b.s{bm} AS DOUBLE), 0) AS stocks_qty
    FROM d_restaurants r
    LEFT JOIN (SELECT restaurant_id, count(*) AS n, sum(total_amount) AS s FROM d_orders GROUP BY 1) o ON o.restaurant_id = r.id
    LEFT JOIN (SELECT restaurant_id, count(*) AS n, sum(qty) AS s FROM d_batches GROUP BY 1) b ON b.restaurant_id = r.id"""


@query("o37_location_summary", SUMMARY.format(om="", bm=""))
def _(c):
    return rep.location_summary(c.restaurants, c.orders, c.batches)


@query("o37_location_summary_compat", SUMMARY.format(om=" * COALESCE(b.n, 1)", bm=" * COALESCE(o.n, 1)"))
def _(c):
    return rep.location_summary(c.restaurants, c.orders, c.batches, compat=True)


@query(
    "o38_popularity_by_home",
    f"""SELECT r.name AS restaurant, d.name AS dish, CAST(SUM(i.qty) AS BIGINT) AS total_ordered
        FROM d_items i JOIN d_dishes d ON i.dish_id = d.id JOIN d_restaurants r ON d.restaurant_id = r.id
        JOIN d_orders o ON i.order_id = o.id WHERE {SOLD_SQL} GROUP BY 1, 2""",
)
def _(c):
    return rep.popularity_by_home(c.items, c.orders_by_key, c.dishes, c.restaurants)


BY_ORDER = """
    SELECT r.name AS restaurant, d.name AS dish, CAST(SUM(i.qty) AS BIGINT) AS total_qty
    FROM d_items i JOIN d_orders o ON o.id = i.order_id JOIN d_dishes d ON d.id = i.dish_id
    JOIN d_restaurants r ON r.id = o.restaurant_id GROUP BY 1, 2"""


@query("o39_popularity_by_order", BY_ORDER)
def _(c):
    return rep.popularity_by_order(c.items, c.orders, c.dishes, c.restaurants)


@query(
    "o40_hourly_load_sold",
    f"""SELECT r.name AS restaurant, CAST(hour(o.order_time) AS BIGINT) AS hour_of_day, count(*) AS order_count
        FROM d_order_log o JOIN d_restaurants r ON o.restaurant_id = r.id WHERE {SOLD_SQL} GROUP BY 1, 2""",
)
def _(c):
    return rep.hourly_load(c.order_log, c.restaurants)


@query(
    "o41_hourly_load",
    """SELECT r.name AS restaurant, CAST(hour(o.order_time) AS BIGINT) AS hour_of_day, count(*) AS order_count
       FROM d_order_log o JOIN d_restaurants r ON o.restaurant_id = r.id GROUP BY 1, 2""",
)
def _(c):
    return rep.hourly_load(c.order_log, c.restaurants, states=None)


@query(
    "o42_evening_load",
    f"""SELECT r.name AS restaurant, count(*) AS order_count
        FROM d_order_log o JOIN d_restaurants r ON o.restaurant_id = r.id
        WHERE {SOLD_SQL} AND hour(o.order_time) BETWEEN 18 AND 20 GROUP BY 1""",
)
def _(c):
    return rep.hourly_load(c.order_log, c.restaurants, hours=(18, 20), split=False)


STAFF = """FROM d_orders o JOIN d_users u ON o.created_by_user = u.id
    JOIN d_employees e ON u.employee_id = e.id WHERE o.status IN ('completed', 'served') GROUP BY 1"""


@query("o43_orders_per_employee", f"SELECT e.full_name AS employee, count(DISTINCT o.id) AS orders_handled {STAFF}")
def _(c):
    return rep.orders_per_employee(c.orders_by_key, c.users, c.employees)


@query(
    "o44_revenue_per_employee",
    f"SELECT e.full_name AS employee, CAST(COALESCE(SUM(o.total_amount), 0) AS DOUBLE) AS total_revenue {STAFF}",
)
def _(c):
    return rep.revenue_per_employee(c.orders_by_key, c.users, c.employees)


@query(
    "o45_ingredient_usage",
    f"""SELECT g.name AS ingredient, CAST(SUM(rc.qty_required * i.qty) AS DOUBLE) AS total_used
        FROM d_items i JOIN d_recipe rc ON i.dish_id = rc.dish_id JOIN d_ingredients g ON rc.ingredient_id = g.id
        JOIN d_orders o ON i.order_id = o.id WHERE {SOLD_SQL} GROUP BY 1""",
)
def _(c):
    return rep.ingredient_usage(c.items, c.recipe, c.ingredients, c.orders_by_key)


@query(
    "o46_top_ingredients",
    """SELECT g.name AS ingredient, CAST(SUM(rc.qty_required * i.qty) AS DOUBLE) AS total_used
       FROM d_items i JOIN d_recipe rc ON i.dish_id = rc.dish_id JOIN d_ingredients g ON rc.ingredient_id = g.id
       GROUP BY 1 ORDER BY total_used DESC, 1 LIMIT 10""",
)
def _(c):
    return rep.top_ingredients(rep.ingredient_usage(c.items, c.recipe, c.ingredients))


@query(
    "o47_busiest_hour",
    f"""SELECT CAST(hour(o.order_time) AS BIGINT) AS hour_of_day, CAST(SUM(i.qty) AS BIGINT) AS total_dishes
        FROM d_order_log o JOIN d_log_items i ON o.id = i.order_id WHERE {SOLD_SQL}
        GROUP BY 1 ORDER BY total_dishes DESC, 1 LIMIT 1""",
)
def _(c):
    return rep.busiest_hour(c.log_items, c.order_log)


@query(
    "o48_demand_by_day",
    f"""SELECT d.name AS dish_name, r.name AS restaurant_name, d.category,
               strftime(CAST(o.order_time AS DATE), '%Y-%m-%d') AS order_date,
               CAST(SUM(i.qty) AS BIGINT) AS daily_quantity, count(DISTINCT o.id) AS daily_orders
        FROM d_orders o JOIN d_items i ON o.id = i.order_id JOIN d_dishes d ON i.dish_id = d.id
        JOIN d_restaurants r ON d.restaurant_id = r.id
        WHERE {SOLD_SQL} AND o.order_time >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY GROUP BY 1, 2, 3, 4""",
)
def _(c):
    return rep.demand_by_day(c.items, c.orders_by_key, c.dishes, c.restaurants, AS_OF)


DAILY = f"""
    SELECT CAST(o.order_time AS DATE) AS day, d.name AS dish, CAST(SUM(i.qty) AS BIGINT) AS qty
    FROM d_orders o JOIN d_items i ON o.id = i.order_id JOIN d_dishes d ON i.dish_id = d.id
    WHERE {SOLD_SQL} GROUP BY 1, 2"""


@query("o49_daily_demand", f"SELECT strftime(day, '%Y-%m-%d') AS day, dish, qty FROM ({DAILY})")
def daily(c):
    return rep.daily_demand(c.items, c.orders_by_key, c.dishes)


@query(
    "o50_demand_by_weekday",
    f"""SELECT d.name AS dish_name, CAST(dayofweek(o.order_time) AS BIGINT) AS day_of_week,
               round(CAST(SUM(i.qty) AS DOUBLE) / count(*), 6) AS avg_qty_per_order,
               CAST(SUM(i.qty) AS BIGINT) AS total_qty, count(*) AS total_orders
        FROM d_orders o JOIN d_items i ON o.id = i.order_id JOIN d_dishes d ON i.dish_id = d.id
        WHERE {SOLD_SQL} GROUP BY 1, 2""",
)
def _(c):
    out = rep.demand_by_weekday(c.items, c.orders_by_key, c.dishes)
    return out.withColumn("avg_qty_per_order", F.round("avg_qty_per_order", 6))


@query(
    "o51_category_revenue_by_home",
    f"""SELECT r.name AS restaurant, d.category, CAST(SUM(i.qty * i.price_at_order) AS DOUBLE) AS category_revenue
        FROM d_items i JOIN d_dishes d ON i.dish_id = d.id JOIN d_restaurants r ON d.restaurant_id = r.id
        JOIN d_orders o ON i.order_id = o.id WHERE {SOLD_SQL} GROUP BY 1, 2""",
)
def _(c):
    return rep.category_revenue_by_home(c.items, c.orders_by_key, c.dishes, c.restaurants)


@query(
    "o52_category_revenue_by_order",
    """SELECT r.name AS restaurant, d.category, CAST(SUM(i.qty * i.price_at_order) AS DOUBLE) AS revenue
       FROM d_items i JOIN d_orders o ON o.id = i.order_id JOIN d_dishes d ON d.id = i.dish_id
       JOIN d_restaurants r ON r.id = o.restaurant_id GROUP BY 1, 2""",
)
def _(c):
    return rep.category_revenue_by_order(c.items, c.orders, c.dishes, c.restaurants)


@query(
    "o53_top_revenue_dishes",
    f"""SELECT r.name AS restaurant, d.name AS dish, CAST(SUM(i.qty * i.price_at_order) AS DOUBLE) AS total_revenue
        FROM d_items i JOIN d_dishes d ON i.dish_id = d.id JOIN d_restaurants r ON d.restaurant_id = r.id
        JOIN d_orders o ON i.order_id = o.id WHERE {SOLD_SQL} GROUP BY 1, 2
        ORDER BY total_revenue DESC, 1, 2 LIMIT 10""",
)
def _(c):
    return rep.top_revenue_dishes(c.items, c.orders_by_key, c.dishes, c.restaurants)


@query(
    "o54_staff_roster",
    """SELECT e.full_name, u.username, CAST(a.restaurant_id AS BIGINT) AS restaurant_id, r.name AS role
       FROM d_employees e JOIN d_users u ON e.id = u.employee_id JOIN d_user_roles a ON u.id = a.user_id
       JOIN d_roles r ON a.role_id = r.id""",
)
def _(c):
    return rep.staff_roster(c.employees, c.users, c.user_roles, c.roles)


@query(
    "o54_account_roster",
    """SELECT u.username, ar.name AS role, r.name AS restaurant
       FROM d_user_roles a JOIN d_users u ON a.user_id = u.id JOIN d_roles ar ON a.role_id = ar.id
       LEFT JOIN d_restaurants r ON a.restaurant_id = r.id""",
)
def _(c):
    return rep.account_roster(c.users, c.user_roles, c.roles, c.restaurants)


@query(
    "o55_dish_sales",
    """SELECT d.id AS dish_id, d.name AS dish_name, CAST(SUM(i.qty) AS BIGINT) AS total_qty,
              CAST(SUM(i.qty * i.price_at_order) AS DOUBLE) AS total_revenue, CAST(d.price AS DOUBLE) AS price
       FROM d_dishes d LEFT JOIN d_items i ON i.dish_id = d.id
       LEFT JOIN d_orders o ON o.id = i.order_id AND o.status IN ('completed', 'served')
       GROUP BY d.id, d.name, d.price HAVING SUM(i.qty) > 0""",
)
def _(c):
    return rep.dish_sales(c.items, c.dishes)


@query(
    "o55_dish_sales_sold",
    f"""SELECT d.id AS dish_id, d.name AS dish_name, CAST(SUM(i.qty) AS BIGINT) AS total_qty,
               CAST(SUM(i.qty * i.price_at_order) AS DOUBLE) AS total_revenue, CAST(d.price AS DOUBLE) AS price
        FROM d_dishes d JOIN d_items i ON i.dish_id = d.id JOIN d_orders o ON o.id = i.order_id
        WHERE {SOLD_SQL} GROUP BY d.id, d.name, d.price HAVING SUM(i.qty) > 0""",
)
def _(c):
    return rep.dish_sales(c.items, c.dishes, c.orders_by_key, SOLD)


CATEGORY_SALES = f"""
    SELECT d.name, d.category, round(CAST(SUM(i.price_at_order) AS DOUBLE) / count(*), 6) AS avg_price,
           CAST(SUM(i.qty) AS BIGINT) AS total_qty, CAST(SUM(i.qty * i.price_at_order) AS DOUBLE) AS revenue
    FROM d_dishes d JOIN d_items i ON i.dish_id = d.id JOIN d_orders o ON i.order_id = o.id
    WHERE {SOLD_SQL} GROUP BY 1, 2 HAVING SUM(i.qty) > 0"""


@query("o55_category_sales", CATEGORY_SALES)
def _(c):
    out = rep.category_sales(c.items, c.orders_by_key, c.dishes)
    return out.withColumn("avg_price", F.round("avg_price", 6))


@query(
    "o56_grand_totals",
    """SELECT count(*) AS rows, CAST(SUM(q) AS BIGINT) AS total_qty_sum, CAST(SUM(v) AS DOUBLE) AS total_revenue_sum,
              round(CAST(SUM(q) AS DOUBLE) / count(*), 4) AS total_qty_mean,
              round(CAST(SUM(v) AS DOUBLE) / count(*), 4) AS total_revenue_mean
       FROM (SELECT dish_id, SUM(qty) AS q, SUM(qty * price_at_order) AS v FROM d_items GROUP BY 1)""",
)
def _(c):
    out = rep.with_totals(rep.dish_sales(c.items, c.dishes), ["total_qty", "total_revenue"])
    return out.withColumns(
        {f"{m}_mean": F.round(f"{m}_mean", 4) for m in ("total_qty", "total_revenue")}
    )


@query(
    "o57_best_selling",
    f"""SELECT dish, CAST(SUM(qty) AS BIGINT) AS total_qty FROM ({DAILY}) GROUP BY 1
        ORDER BY total_qty DESC, dish LIMIT 1""",
)
def _(c):
    return rep.best_selling(daily(c))


@query("o58_label_counts", "SELECT CAST(quality AS BIGINT) AS quality, count(*) AS cnt FROM labels GROUP BY 1")
def _(c):
    return rep.label_counts(c.raw("labels"), "quality")


@query(
    "o60_top_per_location",
    f"""SELECT restaurant, dish, total_qty, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY restaurant ORDER BY total_qty DESC, dish) AS rank
           FROM ({BY_ORDER})) WHERE rank <= 5""",
)
def _(c):
    return rep.top_per_location(rep.popularity_by_order(c.items, c.orders, c.dishes, c.restaurants))
