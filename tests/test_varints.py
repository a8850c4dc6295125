"""Packed lists of (id, amount), and the needs of orders made of them."""

from decimal import Decimal

import numpy as np
import pytest

from tavola.functions import varints
from tavola.operators import fifo

from tests.conftest import rows

BIG = 2**63 - 1
RECIPE = "dish_id int, ingredient_id int, qty_required decimal(12,4)"


def test_numbers_of_any_size_come_back():
    v = np.array([0, 1, -1, 63, -64, 64, 300, -(10**9), BIG, -BIG - 1], np.int64)
    data, size = varints.written(varints.zigzag(v))
    assert size.tolist() == [1, 1, 1, 1, 1, 2, 2, 5, 10, 10]
    assert varints.unzigzag(varints.read(data)[0]).tolist() == v.tolist()
    assert [len(x) for x in varints.read(data[:0])] == [0, 0]


def test_lists_come_back_with_nulls_and_extremes():
    entries = [(0, 5, 10), (0, 5, 10), (0, None, 10), (2, -3, None), (2, None, None), (2, BIG, 1), (2, -BIG - 1, 1), (3, 9, -BIG - 1)]
    row, ids, amounts = zip(*entries)
    columns = [np.array([v or 0 for v in c], np.int64) for c in (ids, amounts)]
    nulls = [np.array([v is None for v in c]) for c in (ids, amounts)]
    data, offsets = varints.packed(np.array(row), columns[0], nulls[0], columns[1], nulls[1], 5)
    at, ids, no_id, amounts, no_amount = varints.unpacked(data, offsets)
    got = [(int(r), None if a else int(i), None if b else int(n)) for r, i, a, n, b in zip(at, ids, no_id, amounts, no_amount)]
    assert sorted(map(str, got)) == sorted(map(str, entries))
    assert [len(x) for x in varints.unpacked(data[:0], np.zeros(3, np.int64))] == [0] * 5


def test_recipes_move_in_few_bytes(spark):
    """Thirty ingredients of neighbouring numbers take 40 bytes, not 32 bytes each."""
    recipe = spark.createDataFrame([(d, 1000 * d + 7 * i, Decimal(2)) for d in range(5) for i in range(30)], RECIPE)
    orders = spark.createDataFrame([(1, 3)], "id long, restaurant_id int")
    items = spark.createDataFrame([(1, d, 2) for d in range(5)], "order_id long, dish_id int, qty int")
    stored, store = [], fifo.store
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fifo, "store", lambda df, name: stored.append(store(df, name)) or stored[-1])
        made = fifo.demand_lines(items, recipe, orders)
    assert max(len(r["parts"]) for r in stored[0].collect()) <= 40
    assert rows(made) == rows(spark.createDataFrame([(3, 1000 * d + 7 * i, 1, Decimal(4)) for d in range(5) for i in range(30)], "a int, b int, c long, d decimal(28,4)"))


def test_orders_of_one_location_lie_together(spark, monkeypatch):
    """A task meets few locations, so that sums by location and ingredient are short."""
    monkeypatch.setattr(fifo, "NEEDS_PER_TASK", 100)
    orders = spark.createDataFrame([(o, o % 4) for o in range(800)], "id long, restaurant_id int")
    items = spark.createDataFrame([(o, 1, 1) for o in range(800)], "order_id long, dish_id int, qty int")
    recipe = spark.createDataFrame([(1, i, Decimal(1)) for i in range(2)], RECIPE)
    places = fifo.demand_lines(items, recipe, orders).rdd.mapPartitions(lambda p: [len({r["restaurant_id"] for r in p})]).collect()
    assert len(places) >= 16 and max(places) <= 2


def test_nulls_and_repeated_rows_of_recipes_and_items(spark):
    items = spark.createDataFrame([(1, 7, 2), (1, 8, None), (1, 7, None), (2, 8, 4), (None, 7, 1), (1, None, 1), (3, 7, 1)], "order_id long, dish_id int, qty int")
    recipe = spark.createDataFrame([(7, 1, Decimal("0.5")), (7, 1, Decimal(2)), (7, None, Decimal(3)), (8, 1, Decimal(1)), (8, 2, None), (8, 3, Decimal(1)), (None, 1, Decimal(1))], RECIPE)
    orders = spark.createDataFrame([(1, 3), (2, None), (2, None), (4, 1)], "id long, restaurant_id int")
    want = [(3, 1, 1, Decimal(5)), (3, 2, 1, None), (3, 3, 1, None), (3, None, 1, Decimal(6)), (None, 1, 2, Decimal(8)), (None, 2, 2, None), (None, 3, 2, Decimal(8))]
    schema = "restaurant_id int, ingredient_id int, order_id long, need decimal(28,4)"
    made = fifo.demand_lines(items, recipe, orders)
    assert rows(made) == rows(spark.createDataFrame(want, schema)) and made.dtypes == spark.createDataFrame(want, schema).dtypes
    assert fifo.demand_lines(items.where("false"), recipe, orders).count() == 0


def test_sums_beyond_a_long_are_an_error(spark):
    items = spark.createDataFrame([(1, 7, 2**31 - 1)] * 4, "order_id long, dish_id int, qty int")
    orders = spark.createDataFrame([(1, 3)], "id long, restaurant_id int")
    for amount, fits in (("99999999.9999", False), ("1.0000", True)):
        made = fifo.demand_lines(items, spark.createDataFrame([(7, 1, Decimal(amount))], RECIPE), orders)
        if fits:
            assert made.first()["need"] == 4 * (2**31 - 1)
        else:
            with pytest.raises(Exception):
                made.collect()
