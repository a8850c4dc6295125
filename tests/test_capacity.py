from tavola.operators import capacity as cap
from tests.conftest import rows


def test_eta(spark):
    places = spark.createDataFrame([(1, 1, "a", 8), (2, 1, "b", 8), (3, 1, "c", 0)],
                                   "id int, city_id int, name string, max_concurrent_orders int")
    orders = spark.createDataFrame(
        [(1, "created")] * 7 + [(1, "served")] * 5 + [(2, "confirmed")] * 5 + [(2, "preparing")] * 3 + [(3, "created")] * 2,
        "restaurant_id int, status string",
    )
    dishes = spark.createDataFrame([(2, 19), (2, 20), (2, None)], "restaurant_id int, prep_time_minutes int")
    assert rows(cap.location_eta(places, orders, dishes), "id", "eta_minutes") == [(1, None), (2, 20), (3, 60)]


def test_alternative_locations(spark):
    etas = spark.createDataFrame(
        [(1, 1, "a", None), (2, 1, "b", 59), (3, 1, "c", 60), (4, 1, "d", None), (5, 1, "e", 5), (6, 2, "f", None)],
        "id int, city_id int, name string, eta_minutes int",
    )
    got = rows(cap.alternative_locations(etas), "restaurant_id", "rank", "id")
    assert [g for g in got if g[0] == 1] == [(1, 1, 4), (1, 2, 5), (1, 3, 2)]
    assert [g for g in got if g[0] == 3] == [(3, 1, 1), (3, 2, 4), (3, 3, 5)]
    assert not [g for g in got if g[0] == 6]


def test_alternative_dishes(spark):
    dishes = spark.createDataFrame(
        [(i, 1, f"d{i}", "soup", i != 3) for i in range(1, 8)] + [(8, 1, "x", None, True), (9, 1, "y", None, True), (10, 2, "z", "soup", True)],
        "id int, restaurant_id int, name string, category string, is_available boolean",
    )
    got = rows(cap.alternative_dishes(dishes, n=3), "for_id", "rank", "dish_id")
    assert [g[2] for g in got if g[0] == 1] == [2, 4, 5]
    assert [g[2] for g in got if g[0] == 3] == [1, 2, 4]
    assert [g[2] for g in got if g[0] == 7] == [1, 2, 4]
    assert not [g for g in got if g[0] in (8, 9, 10)]
    places = spark.createDataFrame([(1, "here"), (2, "there")], "id int, name string")
    assert rows(cap.alternatives_for_unavailable(dishes, places)) == [
        ("d3", "here", "d1"), ("d3", "here", "d2"), ("d3", "here", "d4")
    ]
