"""Views that follow the session's viewer."""

from pyspark.sql import functions as F

from tavola.operators import access, policyviews
from tavola.sources.chain import Chain
from tests.conftest import rows


def test_views_follow_the_viewer(spark, data):
    c = Chain(spark, data)
    tables = {"orders": c.orders, "order_items": c.items, "dishes": c.dishes, "employees": c.employees, "feedbacks": c.feedbacks, "roles": c.roles}
    names = policyviews.define(spark, tables, c.assignments)
    assert names == [f"visible_{t}" for t in tables if t != "roles"]
    for role in ("admin", "analyst", "manager", "waiter", "cook", "nobody", None):
        policyviews.become(spark, role, 3)
        for name in names:
            table = name.removeprefix("visible_")
            want = access.row_filter(tables[table], table, role, 3, orders=c.orders, assignments=c.assignments)
            assert spark.table(name).count() == want.count(), (role, table)
    policyviews.become(spark, "waiter", None)
    assert spark.table("visible_order_items").count() == 0


def test_any_statement_is_filtered(spark, data):
    c = Chain(spark, data)
    policyviews.define(spark, {"orders": c.orders, "order_items": c.items})
    policyviews.become(spark, "waiter", 3)
    got = spark.sql(
        """WITH x AS (SELECT order_id, sum(qty) AS q FROM visible_order_items GROUP BY 1)
           SELECT o.id, x.q FROM visible_orders o JOIN x ON x.order_id = o.id WHERE o.id IN (SELECT id FROM visible_orders)"""
    )
    mine = c.orders.where("restaurant_id = 3").select(F.col("id").alias("order_id"))
    want = c.items.join(mine, "order_id").groupBy("order_id").agg(F.sum("qty").alias("q"))
    assert rows(got) == rows(want) and got.count() > 0
    policyviews.become(spark, "'; SELECT 1 --", 3)
    assert spark.table("visible_orders").count() == 0
