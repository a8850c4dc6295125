import datetime as dt

from pyspark.sql import functions as F

from tavola.operators import quality as q
from tests.conftest import rows


def test_one_city(spark):
    places = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, city_id int")
    links = spark.createDataFrame([(1, 7, 1), (2, 7, 3), (3, 7, 2), (4, 8, 3)], "id int, employee_id int, restaurant_id int")
    assert rows(q.one_city_only(links, places), "id") == [(1,), (3,), (4,)]
    assert rows(q.many_cities(links, places)) == [(7, 2)]


def test_intervals(spark):
    d = dt.datetime(2025, 1, 2)
    df = spark.createDataFrame([(1, d, None), (2, d, d), (3, d, d - dt.timedelta(1)), (4, None, d)],
                               "id int, a timestamp, b timestamp")
    assert rows(q.bad_intervals(df, "a", "b"), "id") == [(3,)]


def test_rules_count_only_false(spark):
    df = spark.createDataFrame([(0,), (3,), (None,)], "rating int")
    rules = {"range": F.col("rating").between(1, 5), "given": q.not_null("rating")}
    assert rows(q.rule_report(df, rules)) == [("given", 1), ("range", 1)]


def test_unique_ignores_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "x int, y string")
    assert rows(q.unique_report([("k", df, ["x", "y"])])) == [("k", 1, 2)]
    assert rows(q.unique_report([("none", df.limit(1), ["x"])])) == [("none", 0, 0)]


def test_references(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert rows(q.reference_report([("r", child, "k", parent, "id")])) == [("r", 1, 2)]


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "k int, v string")
    assert rows(q.insert_or_ignore(old, new, ["k"])) == [(1, "a"), (2, "b")]


def test_ingest(spark):
    seats = spark.createDataFrame([(5, 1, "A")], "id int, restaurant_id int, table_number string")
    df = spark.createDataFrame([(1, 1, "A", None, "7.5"), (2, 2, "A", "served", None), (3, 1, None, "", "1")],
                               "id int, restaurant_id int, table_number string, status string, total string")
    got = rows(q.ingest_orders(df, seats).withColumn("total_amount", F.col("total_amount").cast("double")))
    assert got == [(1, 1, 5, "created", 7.5), (2, 2, None, "served", 0.0), (3, 1, None, "created", 1.0)]
    items = spark.createDataFrame([("1", "2", "x", "3.50")], "order_id string, dish_id string, qty string, price string")
    assert rows(q.ingest_items(items).withColumn("price_at_order", F.col("price_at_order").cast("double"))) == [(1, 2, None, 3.5)]


def test_constants_and_names(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    assert rows(q.set_by_name(df, "name", "n", {"a": 8})) == [("a", 8), ("b", 2)]
    people = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, full_name string")
    assert rows(q.assign_by_name(people, "full_name", {4: ["x"], 5: ["z"]})) == [(1, 4), (3, 5)]


def test_roles_by_prefix(spark):
    users = spark.createDataFrame([("u1", 1, "cook1"), ("u2", 2, "manager"), ("u3", 3, "owner")],
                                  "id string, employee_id int, username string")
    links = spark.createDataFrame([(1, 9), (2, 8), (3, 7)], "employee_id int, restaurant_id int")
    roles = spark.createDataFrame([(1, "cook"), (2, "manager")], "id int, name string")
    assert rows(q.roles_by_prefix(users, links, roles, ["manager", "cook"])) == [("u1", 1, 9), ("u2", 2, 8)]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, '{"id": 3, "z": 1, "b": 2}'), (2, "[1]"), (3, "no")], "n int, body string")
    got = {r["n"]: r for r in q.parse_rows(df, "body", "id int", ["id"]).collect()}
    assert (got[1]["id"], got[1]["unknown_keys"], got[1]["is_object"]) == (3, ["b", "z"], True)
    assert (got[2]["is_object"], got[3]["is_object"]) == (False, False)


def test_misplaced_tables(spark):
    orders = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, None)], "id int, restaurant_id int, table_id int")
    seats = spark.createDataFrame([(5, 1)], "id int, restaurant_id int")
    assert rows(q.misplaced_tables(orders, seats), "id") == [(2,)]
