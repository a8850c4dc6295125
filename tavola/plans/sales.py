"""Sales clusters and demand forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.operators import clustering, forecast, reports as rep, seasonal
from tavola.plans.registry import query
from tavola.plans.reports import CATEGORY_SALES, DAILY

# The categories of the given tables, for the SQL; the operator reads them from the data.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

SALES = """SELECT d.id AS dish_id, d.name AS dish_name, d.prep_time_minutes % 3 AS cluster, SUM(i.qty) AS total_qty,
                  SUM(i.qty * i.price_at_order) AS total_revenue
           FROM d_items i JOIN d_dishes d ON d.id = i.dish_id GROUP BY 1, 2, 3"""


def _grouped(c):
    """Dish sales with a cluster number from the dish itself, so that SQL can follow."""
    groups = c.dishes.select(F.col("id").alias("dish_id"), (F.col("prep_time_minutes") % 3).alias("cluster"))
    return rep.dish_sales(c.items, c.dishes).join(groups, "dish_id")


@query(
    "o61_top_of_cluster",
    f"""SELECT CAST(cluster AS BIGINT) AS cluster, rank, dish_id, dish_name, substr(dish_name, 1, 15) AS short_name,
               CAST(total_revenue AS DOUBLE) AS total_revenue
        FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total_revenue DESC, dish_id) AS rank
              FROM ({SALES})) WHERE rank <= 3""",
)
def _(c):
    top = clustering.top_of_cluster(_grouped(c))
    return top.select("cluster", "rank", "dish_id", "dish_name", "short_name", "total_revenue")


@query(
    "o73c_cluster_names",
    f"""WITH s AS ({SALES}),
        k AS (SELECT cluster, avg(CAST(total_revenue AS DOUBLE)) AS r, avg(CAST(total_qty AS DOUBLE)) AS q FROM s GROUP BY 1),
        t AS (SELECT avg(CAST(total_revenue AS DOUBLE)) AS tr, avg(CAST(total_qty AS DOUBLE)) AS tq FROM s)
        SELECT CAST(cluster AS BIGINT) AS cluster, round(r, 4) AS avg_revenue, round(q, 4) AS avg_qty,
               CASE WHEN r > tr AND q > tq THEN 'ХИТЫ' WHEN r < tr AND q < tq THEN 'СЛАБЫЕ' ELSE 'СРЕДНИЕ' END AS name
        FROM k, t""",
)
def _(c):
    out = clustering.cluster_names(_grouped(c))
    return out.withColumns({m: F.round(m, 4) for m in ("avg_revenue", "avg_qty")})


@query(
    "o73d_one_hot",
    f"""SELECT name, total_qty, {', '.join(f"CAST(category = '{v}' AS BIGINT) AS category_{v}" for v in CATEGORIES)}
        FROM ({CATEGORY_SALES})""",
)
def _(c):
    sales = rep.category_sales(c.items, c.orders_by_key, c.dishes).select("name", "category", "total_qty")
    return clustering.one_hot(sales, "category")


@query("o73a_dish_clusters")
def _(c):
    return clustering.cluster(rep.dish_sales(c.items, c.dishes), ["total_revenue", "total_qty"])


@query("o73b_category_clusters")
def _(c):
    sales = rep.category_sales(c.items, c.orders_by_key, c.dishes)
    return clustering.cluster(sales, ["avg_price", "total_qty", "revenue"])


@query(
    "o72_forecast",
    f"""WITH d AS ({DAILY}),
        p AS (SELECT dish, dayofweek(day) AS w, day - DATE '2000-01-01' AS x, CAST(qty AS DOUBLE) AS y, day FROM d),
        l AS (SELECT dish, regr_slope(y, x) AS s, regr_intercept(y, x) AS b, max(day) AS last_day FROM p
              GROUP BY 1 HAVING count(*) >= 2),
        e AS (SELECT p.dish, p.w, avg(p.y - l.s * p.x - l.b) AS effect FROM p JOIN l USING (dish) GROUP BY 1, 2),
        f AS (SELECT dish, s, b, CAST(last_day + CAST(n AS INT) AS DATE) AS day FROM l, (SELECT unnest(range(1, 8)) AS n))
        SELECT f.dish, strftime(f.day, '%Y-%m-%d') AS day,
               round(b + s * (f.day - DATE '2000-01-01') + COALESCE(e.effect, 0), 5) AS yhat
        FROM f LEFT JOIN e ON e.dish = f.dish AND e.w = dayofweek(f.day)""",
)
def _(c):
    demand = rep.daily_demand(c.items, c.orders_by_key, c.dishes)
    return forecast.forecast(demand).withColumn("yhat", F.round("yhat", 5))


def _facts(clusters, columns):
    """Rows, clusters with members, whether centres ascend, and whether the squares within clusters are at most
    half of all, over standardised columns."""
    typed = clusters.withColumns({c: F.col(c).cast("double") for c in columns})
    whole = typed.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev(c).alias(f"d_{c}") for c in columns])
    scaled = typed.join(F.broadcast(whole)).select("cluster", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).alias(c) for c in columns])
    within = sum((F.var_pop(c) * F.count(F.lit(1)) for c in columns), F.lit(0.0))
    per = scaled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(columns[0]).alias("centre"), within.alias("within"))
    centres = F.transform(F.array_sort(F.collect_list(F.struct("cluster", "centre"))), lambda x: x["centre"])
    return per.agg(
        F.sum("n").alias("rows"),
        F.count_if(F.col("n") > 0).alias("clusters"),
        (centres == F.array_sort(centres)).alias("ascending"),
        # Standardised columns have n - 1 squares each.
        (F.sum("within") <= 0.5 * len(columns) * (F.sum("n") - 1)).alias("tight"),
    )


@query("o73a_dish_cluster_facts", f"SELECT count(*) AS rows, CAST(3 AS BIGINT) AS clusters, true AS ascending, true AS tight FROM ({SALES})")
def _(c):
    columns = ["total_revenue", "total_qty"]
    return _facts(clustering.cluster(rep.dish_sales(c.items, c.dishes), columns), columns)


@query("o73b_category_cluster_facts", f"SELECT count(*) AS rows, CAST(3 AS BIGINT) AS clusters, true AS ascending, true AS tight FROM ({CATEGORY_SALES})")
def _(c):
    columns = ["avg_price", "total_qty", "revenue"]
    sales = rep.category_sales(c.items, c.orders_by_key, c.dishes)
    return _facts(clustering.cluster(sales, columns), columns)


@query("o72_seasonal_forecast")
def _(c):
    demand = rep.daily_demand(c.items, c.orders_by_key, c.dishes)
    return seasonal.forecast(demand).withColumn("yhat", F.round("yhat", 5))


@query(
    "o72_seasonal_days",
    f"""WITH d AS ({DAILY}), l AS (SELECT dish, max(day) AS last_day FROM d GROUP BY 1 HAVING min(day) < max(day))
        SELECT dish, strftime(CAST(last_day + CAST(n AS INT) AS DATE), '%Y-%m-%d') AS day, true AS finite
        FROM l, (SELECT unnest(range(1, 8)) AS n)""",
)
def _(c):
    """Every series with two days has its seven days, each with a number."""
    demand = rep.daily_demand(c.items, c.orders_by_key, c.dishes)
    known = F.col("yhat").isNotNull() & ~F.isnan("yhat") & (F.abs("yhat") < 1e9)
    return seasonal.forecast(demand).select("dish", "day", known.alias("finite"))
