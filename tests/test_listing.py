import datetime as dt

from pyspark.sql import functions as F

from tavola.functions.formatting import as_text, format_datetimes
from tavola.functions.predicates import has_all_words, where_all
from tavola.operators import listing, reports
from tests.conftest import rows


def test_browse(spark):
    df = spark.range(6000).select((5999 - F.col("id")).alias("id"))
    assert listing.browse(df, limit=5500).count() == 5500
    assert listing.browse(df, limit=None).count() == df.count() > 5500
    assert listing.browse(df).count() == 100
    assert [r[0] for r in listing.browse(df, "id > 3", 2).collect()] == [4, 5]
    assert listing.browse(df, " ", 0).count() == 1


def test_where_all_skips_missing(spark):
    df = spark.range(4)
    assert where_all(df, None).count() == 4
    assert where_all(df, None, F.col("id") > 0, F.col("id") < 3).count() == 2


def test_menu(spark):
    dishes = spark.createDataFrame(
        [(1, 1, "Soup 100%", "Hot", 5.0, 3, True), (2, 1, "soup_x", "HOT", 7.0, 3, False), (3, 2, "Cake", None, 9.0, 3, True)],
        "id int, restaurant_id int, name string, category string, price double, prep_time_minutes int, is_available boolean",
    )
    def ids(**a):
        return [r["id"] for r in listing.menu(dishes, **a).collect()]

    assert ids() == [1, 2, 3]
    assert ids(category="hot") == [1, 2]
    assert ids(keyword="SOUP") == [1, 2]
    assert ids(keyword="0%") == [1]
    assert ids(is_available=False) == [2]
    assert ids(price_min=7, price_max=9, restaurant_id=2) == [3]
    assert ids(words="100 soup") == [1]
    assert ids(words="soups") == [] and ids(stems="SOUPS") == [1, 2]


def test_words_need_every_token(spark):
    df = spark.createDataFrame([("Борщ, с мясом",), ("борщ",)], "t string")
    assert [r[0] for r in df.select(has_all_words("t", "МЯСОМ борщ")).collect()] == [True, False]


def test_orders_list_keeps_orders_without_table(spark):
    at = dt.datetime(2025, 1, 1)
    orders = spark.createDataFrame(
        [(1, 1, 9, "g", "created", at, 1), (2, 1, None, "h", "served", at + dt.timedelta(1), 2)],
        "id int, restaurant_id int, table_id int, guest_name string, status string, order_time timestamp, total_amount int",
    )
    seats = spark.createDataFrame([(9, "T9")], "id int, table_number string")
    got = listing.orders_list(orders, seats)
    assert sorted((r["id"], r["table_number"]) for r in got.collect()) == [(1, "T9"), (2, None)]
    assert [r["id"] for r in listing.orders_list(orders, seats, limit=1).collect()] == [2]


def test_formatting(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2, 3, 4, 5), dt.date(2025, 6, 7), None)], "a timestamp, b date, c int")
    assert rows(format_datetimes(df)) == [("2025-01-02 03:04:05", "2025-06-07", None)]
    assert rows(as_text(df)) == [("2025-01-02 03:04:05", "2025-06-07", "")]


def test_summary_does_not_multiply(spark):
    places = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    orders = spark.createDataFrame([(1, 1, 10), (2, 1, 20)], "id int, restaurant_id int, total_amount int")
    stock = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "id int, restaurant_id int, qty int")
    cols = ("restaurant_id", "orders_count", "orders_sum", "stocks_count", "stocks_qty")
    assert rows(reports.location_summary(places, orders, stock), *cols) == [(1, 2, 30, 3, 6), (2, 0, 0, 0, 0)]
    assert rows(reports.location_summary(places, orders, stock, compat=True), *cols)[0] == (1, 2, 90, 3, 12)
    assert rows(reports.location_summary(places, orders, stock, restaurant_id=2), *cols) == [(2, 0, 0, 0, 0)]
