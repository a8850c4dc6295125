import pytest

from tavola.operators import access
from tavola.sources.tables import SCHEMAS
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    placed = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, restaurant_id int")
    return {
        **{t: placed for t in ("orders", "ingredient_batches", "dishes", "purchase_requests",
                               "inventory_movements", "reservations")},
        "order_items": spark.createDataFrame([(10, 1), (11, 3)], "id int, order_id int"),
        "feedbacks": spark.createDataFrame([(20, 2), (21, 3)], "id int, order_id int"),
        "employees": spark.createDataFrame([(5,), (6,)], "id int"),
        "ingredients": spark.createDataFrame([(7,)], "id int"),
        "employee_assignments": spark.createDataFrame([(5, 1), (5, 1), (6, 2)], "employee_id int, restaurant_id int"),
    }


def seen(tables, table, role, location):
    out = access.row_filter(tables[table], table, role, location, tables["orders"], tables["employee_assignments"])
    return sorted(r["id"] for r in out.collect())


OWN = {1: [1, 2], 2: [3]}


@pytest.mark.parametrize("location", [1, 2])
@pytest.mark.parametrize("table, roles", [
    ("orders", "manager waiter cook"), ("ingredient_batches", "manager cook"), ("dishes", "manager waiter cook"),
    ("purchase_requests", "manager cook"), ("inventory_movements", "manager cook"), ("reservations", "manager waiter"),
])
def test_own_location(tables, table, roles, location):
    for role in ("manager", "waiter", "cook"):
        assert seen(tables, table, role, location) == (OWN[location] if role in roles.split() else [])
    for role in ("admin", "analyst"):
        assert seen(tables, table, role, location) == [1, 2, 3]
    assert seen(tables, table, "guest", location) == []
    assert seen(tables, table, "manager", None) == []


def test_through_parents(tables):
    assert seen(tables, "order_items", "waiter", 1) == [10]
    assert seen(tables, "order_items", "cook", 2) == [11]
    assert seen(tables, "feedbacks", "manager", 1) == [20]
    assert seen(tables, "feedbacks", "waiter", 1) == []
    assert seen(tables, "employees", "manager", 1) == [5]
    assert seen(tables, "employees", "admin", None) == [5, 6]
    assert seen(tables, "employees", "analyst", None) == []
    assert seen(tables, "ingredients", "manager", 1) == []
    assert seen(tables, "ingredients", "analyst", None) == [7]


def test_insert_check(spark, tables):
    viewers = spark.createDataFrame(
        [(1, "waiter", 1), (2, "cook", 1), (3, "admin", None), (4, "manager", 2)],
        "user_id int, role string, restaurant_id int")
    asked = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 3), (3, 99), (4, 3), (9, 1)], "user_id int, order_id int")
    got = rows(access.check_item_inserts(asked, tables["orders"], viewers), "user_id", "order_id", "accepted")
    assert got == [(1, 1, True), (1, 3, False), (2, 1, False), (3, 3, True), (3, 99, False), (4, 3, True), (9, 1, False)]


def test_grants(spark):
    matrix = access.grant_matrix(spark, sorted(SCHEMAS))
    assert matrix.where("role = 'admin'").count() == 4 * 21
    assert rows(matrix.where("role = 'waiter' AND verb = 'UPDATE'")) == [("waiter", "UPDATE", "orders", "status")]
    assert matrix.where("role = 'analyst' AND table_name = 'app_users'").isEmpty()
    modules = rows(access.module_matrix(spark).where("role = 'cook'"), "module")
    assert modules == [("inventory",), ("menu",), ("purchase",)]


def test_scoping(spark, tables):
    orders = tables["orders"]
    assert access.scoped(orders, "waiter", 1).count() == 2
    assert access.scoped(orders, "waiter", None).count() == 3
    assert access.scoped(orders, "admin", 1).count() == 3


def test_primary_role_is_first_by_name(spark):
    links = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, None)], "user_id int, role_id int, restaurant_id int")
    roles = spark.createDataFrame([(1, "waiter"), (2, "cook")], "id int, name string")
    assert rows(access.primary_roles(links, roles)) == [(1, "cook", 6), (2, "waiter", None)]
