import datetime as dt
from decimal import Decimal as D

from tavola.operators import inventory as inv
from tests.conftest import rows

BATCH = "restaurant_id int, ingredient_id int, id long, qty decimal(12,4), expiry_date date, active boolean, min_threshold decimal(12,4)"


def batches(spark, data):
    return spark.createDataFrame(data, BATCH)


def test_order_totals_cover_empty_orders(spark):
    orders = spark.createDataFrame([(1,), (2,)], "id int")
    items = spark.createDataFrame([(1, 2, D("10.50")), (1, 1, D("4.00"))], "order_id int, qty int, price_at_order decimal(12,2)")
    assert rows(inv.order_totals(orders, items)) == [(1, D("25.00")), (2, D("0.00"))]


def test_availability(spark):
    dishes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "id int, restaurant_id int")
    recipe = spark.createDataFrame(
        [(2, 1, D("5.0001")), (3, 1, D("5.0000")), (4, 9, D("1"))], "dish_id int, ingredient_id int, qty_required decimal(12,4)"
    )
    stock = batches(spark, [(1, 1, 1, D(2), None, True, None), (1, 1, 2, D(3), None, True, None),
                            (1, 1, 3, D(9), None, False, None), (2, 1, 4, D(9), None, True, None)])
    assert rows(inv.dish_availability(dishes, recipe, stock)) == [
        (1, 1, True), (2, 1, False), (3, 1, True), (4, 1, False)
    ]


def test_more_stock_never_hides_a_dish(spark):
    dishes = spark.createDataFrame([(i, 1) for i in range(9)], "id int, restaurant_id int")
    recipe = spark.createDataFrame([(i, i % 3, D(i)) for i in range(9)], "dish_id int, ingredient_id int, qty_required decimal(12,4)")
    less = batches(spark, [(1, i, i, D(3), None, True, None) for i in range(3)])
    more = batches(spark, [(1, i, i, D(5), None, True, None) for i in range(3)])
    seen = lambda b: {r["id"] for r in inv.dish_availability(dishes, recipe, b).collect() if r["is_available"]}
    assert seen(less) < seen(more)


def test_reorder(spark):
    after = batches(spark, [
        (1, 1, 1, D(4), None, True, D(4)),   # at the threshold
        (1, 2, 2, D(1), None, True, D(4)),   # open request
        (1, 3, 3, D(5), None, True, None),   # default threshold
        (1, 4, 4, D(6), None, True, None),   # above the default
        (1, 5, 5, D(0), None, True, D(9)),   # not touched
        (1, 6, 6, D(9), None, False, D(3)), (1, 6, 7, D(1), None, True, D(2)),  # smallest threshold
    ])
    touched = after.where("ingredient_id <> 5").select("restaurant_id", "ingredient_id")
    requests = spark.createDataFrame(
        [(1, 2, "ordered"), (1, 1, "received"), (2, 1, "new")], "restaurant_id int, ingredient_id int, status string"
    )
    got = rows(inv.reorder(after, touched, requests), "ingredient_id", "qty", "status")
    assert got == [(1, D(40), "new"), (3, D(50), "new"), (6, D(20), "new")]


def test_expire(spark):
    today = dt.date(2025, 5, 5)
    stock = batches(spark, [(1, 1, 1, D(1), today, True, None), (1, 1, 2, D(1), today - dt.timedelta(1), True, None),
                            (1, 1, 3, D(1), None, True, None), (1, 1, 4, D(1), None, False, None)])
    assert rows(inv.expire(stock, today), "id", "active") == [(1, True), (2, False), (3, True), (4, False)]


def test_finalise(spark):
    before, at = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1, 10)
    orders = spark.createDataFrame(
        [(1, "created", False, 7, None, None), (2, "completed", True, 8, before, 4), (3, "created", False, 9, None, None),
         (4, "created", False, 6, None, None)],
        "id long, status string, is_finalized boolean, created_by_user long, completed_at timestamp_ntz, completed_by_user long",
    )
    accepted = spark.createDataFrame([(1, True), (3, False)], "order_id long, accepted boolean")
    got = rows(inv.finalise(orders, at, accepted=accepted))
    assert got == [(1, "completed", True, at, 7), (2, "completed", True, before, 4), (3, "created", False, None, None),
                   (4, "completed", True, at, 6)]
    named = rows(inv.finalise(orders, at, user=5), "id", "completed_by_user")
    assert named == [(1, 5), (2, 4), (3, 5), (4, 5)]


def test_finalise_all(spark):
    at = dt.datetime(2025, 1, 1)
    orders = spark.createDataFrame(
        [(i, "created", False, i, None, None) for i in (1, 2, 3)],
        "id long, status string, is_finalized boolean, created_by_user long, completed_at timestamp_ntz, completed_by_user long",
    )
    stock = batches(spark, [(1, 1, 1, D(5), None, True, None)])
    needs = spark.createDataFrame([(1, 1, 1, D(4)), (1, 1, 2, D(3))], "restaurant_id int, ingredient_id int, order_id long, need decimal(12,4)")
    dishes = spark.createDataFrame([(1, 1), (2, 1)], "id int, restaurant_id int")
    recipe = spark.createDataFrame([(1, 1, D(1)), (2, 1, D(2))], "dish_id int, ingredient_id int, qty_required decimal(12,4)")
    made = inv.finalise_all(orders, needs, stock, dishes, recipe, at)
    assert rows(made["orders"], "id", "is_finalized") == [(1, True), (2, False), (3, True)]
    assert rows(made["movements"], "batch_id", "change_qty", "related_order_id") == [(1, D(-4), 1)]
    assert rows(made["batches"], "id", "qty") == [(1, D(1))]
    assert rows(made["dishes"], "id", "is_available") == [(1, True), (2, False)]


def test_reorder_without_depletion(spark, data):
    from tavola.operators import fifo
    from tavola.sources.chain import Chain

    c = Chain(spark, data)
    lean = inv.reorder_after(c.batches, c.consumption, c.purchase_requests)
    whole = inv.reorder(fifo.deplete(c.batches, c.consumption), c.consumption, c.purchase_requests)
    assert rows(lean) == rows(whole)
    assert "Window" not in lean._jdf.queryExecution().optimizedPlan().toString()


def test_manual_requests(spark):
    stock = batches(spark, [(1, 1, 1, D(1), None, True, D(3)), (1, 2, 2, D(1), None, True, D(0)),
                            (1, 3, 3, D(1), None, True, None), (1, 4, 4, D(1), None, True, D(8))])
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(inv.manual_requests(stock, chosen), "ingredient_id", "qty") == [(1, D(3)), (2, D(1)), (3, D(1))]
    assert {r["qty"] for r in inv.manual_requests(stock, chosen, 2.5).collect()} == {D("2.5")}


def test_adjust(spark):
    stock = batches(spark, [(1, 1, 1, D(1), None, True, None), (1, 1, 2, D(2), None, True, None)])
    day = dt.date(2025, 1, 2)
    changes = spark.createDataFrame([(1, None, day)], "id long, qty decimal(12,4), expiry_date date")
    assert rows(inv.adjust(stock, changes, ["id"]), "id", "qty", "expiry_date") == [(1, D(1), day), (2, D(2), None)]
