"""Depletion of stock against a row-by-row walk."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tavola.operators import fifo
from tests.conftest import rows

LOTS = "restaurant_id int, ingredient_id int, id long, qty decimal(12,4), expiry_date date, active boolean, min_threshold decimal(12,4)"
NEEDS = "restaurant_id int, ingredient_id int, order_id long, need decimal(12,4)"
DAY = dt.date(2025, 1, 1)
SMALL = {"width": 3, "span": 7.0}


def lots(spark, data):
    return spark.createDataFrame(
        [(1, 1, i, Decimal(q), e, a, Decimal(0)) for i, q, e, a in data], LOTS
    )


def needs(spark, data):
    return spark.createDataFrame([(1, 1, o, Decimal(n)) for o, n in data], NEEDS)


def day(n):
    return DAY + dt.timedelta(days=n)


def walk(stock, wants, strict):
    """Serve wants in order from lots by expiry; returns takes, shortage and the lots after."""
    far = dt.date(9999, 1, 1)
    order = {}
    for r, i, b, q, e, active, _ in stock:
        if active and q > 0:
            order.setdefault((r, i), []).append([e or far, b, q])
    for lot in order.values():
        lot.sort()
    takes, short, refused = {}, {}, set()
    by_order = {}
    for r, i, o, n in wants:
        by_order.setdefault(o, []).append((r, i, n))
    for o in sorted(by_order):
        enough = all(sum(x[2] for x in order.get((r, i), [])) >= n for r, i, n in by_order[o])
        if strict and not enough:
            refused.add(o)
            continue
        for r, i, n in by_order[o]:
            for lot in order.get((r, i), []):
                take = min(n, lot[2])
                if take > 0:
                    takes[(r, i, o, lot[1])] = takes.get((r, i, o, lot[1]), 0) + take
                    lot[2] -= take
                    n -= take
            if n > 0:
                short[(r, i, o)] = n
    return takes, short, refused


def random_case(seed):
    rng = random.Random(seed)
    stock = [
        (rng.randint(1, 2), rng.randint(1, 3), b, Decimal(rng.randint(0, 9)),
         rng.choice([None, day(rng.randint(0, 4))]), rng.random() < 0.8, Decimal(1))
        for b in range(60)
    ]
    # One key holds about a third of all needs.
    wants = {}
    for o in range(60):
        for _ in range(rng.randint(1, 3)):
            key = (1, 1) if rng.random() < 0.34 else (rng.randint(1, 2), rng.randint(1, 3))
            wants[(*key, o)] = Decimal(rng.randint(1, 4)) + Decimal("0.2500")
    # An order belongs to one location.
    kept = {}
    for (r, i, o), n in wants.items():
        kept[(1 + o % 2, i, o)] = n
    return stock, [(*k, n) for k, n in kept.items()]


def test_three_lots(spark):
    stock = lots(spark, [(1, 5, day(1), True), (2, 3, day(2), True), (3, 9, None, True)])
    got = fifo.fifo_allocate(stock, needs(spark, [(10, 4), (11, 6)]))
    assert rows(got, "order_id", "batch_id", "take") == [
        (10, 1, Decimal(4)), (11, 1, Decimal(1)), (11, 2, Decimal(3)), (11, 3, Decimal(2)),
    ]


def test_partial_shortage(spark):
    stock, want = lots(spark, [(1, 5, day(1), True)]), needs(spark, [(1, 4), (2, 3)])
    assert rows(fifo.fifo_allocate(stock, want), "order_id", "take") == [(1, Decimal(4)), (2, Decimal(1))]
    assert rows(fifo.fifo_shortage(stock, want), "order_id", "short_qty") == [(2, Decimal(2))]


def test_strict_shortage(spark):
    stock, want = lots(spark, [(1, 5, day(1), True)]), needs(spark, [(1, 4), (2, 3), (3, 1)])
    assert rows(fifo.accepted_orders(stock, want)) == [(1, True), (2, False), (3, True)]
    assert rows(fifo.fifo_allocate_strict(stock, want), "order_id", "take") == [(1, Decimal(4)), (3, Decimal(1))]


def test_emptied_batches(spark):
    stock = lots(spark, [(1, 5, day(1), True), (2, 3, day(2), True), (3, 9, day(3), True), (4, 2, day(0), False)])
    exact = fifo.deplete(stock, needs(spark, [(1, 5)]))
    assert rows(exact, "id", "qty", "active")[0] == (1, Decimal(0), True)
    past = fifo.deplete(stock, needs(spark, [(1, 6)]))
    assert rows(past, "id", "qty", "active") == [
        (1, Decimal(0), False), (2, Decimal(2), True), (3, Decimal(9), True), (4, Decimal(2), False),
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_walk(spark, seed):
    stock, wants = random_case(seed)
    stock_df, want_df = spark.createDataFrame(stock, LOTS), spark.createDataFrame(wants, NEEDS)
    takes, short, _ = walk(stock, wants, strict=False)
    got = {tuple(r[:4]): r[4] for r in fifo.fifo_allocate(stock_df, want_df, **SMALL).collect()}
    assert got == takes
    lacking = {tuple(r[:3]): r[3] for r in fifo.fifo_shortage(stock_df, want_df, SMALL["width"]).collect()}
    assert lacking == short
    after = {r["id"]: r["qty"] for r in fifo.deplete(stock_df, want_df, **SMALL).collect()}
    used = {}
    for (_, _, _, b), q in takes.items():
        used[b] = used.get(b, 0) + q
    assert after == {s[2]: s[3] - used.get(s[2], 0) for s in stock}


@pytest.mark.parametrize("seed", [4, 5])
def test_random_strict(spark, seed):
    stock, wants = random_case(seed)
    stock_df, want_df = spark.createDataFrame(stock, LOTS), spark.createDataFrame(wants, NEEDS)
    takes, _, refused = walk(stock, wants, strict=True)
    accepted = fifo.accepted_orders(stock_df, want_df, width=5)
    assert {r["order_id"] for r in accepted.collect() if not r["accepted"]} == refused
    got = {tuple(r[:4]): r[4] for r in fifo.fifo_allocate_strict(stock_df, want_df, width=5).collect()}
    assert got == takes
    assert refused


def test_alternating_orders(spark):
    """10,000 orders on one key: each large one is refused, each small one accepted, until nothing is left."""
    wants = [(1, 1, o, Decimal(9 if o % 2 else 1)) for o in range(10_000)]
    stock = [(1, 1, 1, Decimal(4000), DAY, True, Decimal(0)), (1, 1, 2, Decimal("8.5"), None, True, Decimal(0))]
    wants += [(1, 2, o, Decimal(1)) for o in range(0, 10_000, 7)]
    stock.append((1, 2, 3, Decimal(600), DAY, True, Decimal(0)))
    _, _, refused = walk(stock, wants, strict=True)
    got = fifo.accepted_orders(spark.createDataFrame(stock, LOTS), spark.createDataFrame(wants, NEEDS).repartition(3))
    assert {r["order_id"] for r in got.where("NOT accepted").collect()} == refused
    assert got.count() == 10_000 and 0 < len(refused) < 10_000


@pytest.mark.parametrize("seed", [6, 7])
def test_strict_orders_of_several_locations(spark, seed):
    """An order that is refused at one location takes nothing at the others."""
    rng = random.Random(seed)
    stock = [(r, i, 10 * r + i, Decimal(rng.randint(5, 40)), None, True, Decimal(0)) for r in range(1, 7) for i in range(1, 4)]
    wants = {}
    for o in range(120):
        # Locations 1 and 2, and 3 and 4, share orders; 5 and 6 stand alone.
        for r in rng.choice([(1,), (1, 2), (2,), (3, 4), (4,), (5,), (6,)]):
            for i in rng.sample([1, 2, 3], rng.randint(1, 2)):
                wants[(r, i, o)] = Decimal(rng.randint(1, 3)) + Decimal("0.5")
    wants = [(*k, n) for k, n in wants.items()]
    takes, _, refused = walk(stock, wants, strict=True)
    stock_df, want_df = spark.createDataFrame(stock, LOTS), spark.createDataFrame(wants, NEEDS).repartition(3)
    got = fifo.accepted_orders(stock_df, want_df, width=11).collect()
    assert {r["order_id"] for r in got if not r["accepted"]} == refused and len(got) == len({w[2] for w in wants})
    made = {tuple(r[:4]): r[4] for r in fifo.fifo_allocate_strict(stock_df, want_df, width=11).collect()}
    assert made == takes and refused


def test_jobs_do_not_grow_with_orders(spark, monkeypatch):
    cuts = []
    cut = fifo.cut
    monkeypatch.setattr(fifo, "cut", lambda df: cuts.append(1) or cut(df))
    for n in (10, 1000):
        stock = lots(spark, [(1, n, None, True)])
        fifo.accepted_orders(stock, needs(spark, [(o, 3 if o % 2 else 1) for o in range(n)])).collect()
    assert len(cuts) == 4


def test_demand_lines(spark):
    items = spark.createDataFrame([(1, 7, 2), (1, 7, 1), (1, 8, 1), (2, 8, 4)], "order_id long, dish_id int, qty int")
    recipe = spark.createDataFrame([(7, 1, 10), (8, 1, 5), (8, 2, 1)], "dish_id int, ingredient_id int, qty_required int")
    orders = spark.createDataFrame([(1, 3), (2, 4)], "id long, restaurant_id int")
    assert rows(fifo.demand_lines(items, recipe, orders)) == [(3, 1, 1, 35), (3, 2, 1, 1), (4, 1, 2, 20), (4, 2, 2, 4)]


def test_needs_of_orders_are_not_shuffled(spark):
    """Lists of ingredients move; what they unfold to is summed where it is made."""
    items = spark.createDataFrame([(1, 7, 2), (1, 8, 3), (1, 7, 1)], "order_id long, dish_id int, qty int")
    orders = spark.createDataFrame([(1, 3)], "id long, restaurant_id int")
    recipe = spark.createDataFrame([(7, 1, Decimal("0.0001")), (7, 1, Decimal(2)), (8, 1, Decimal(5))], "dish_id int, ingredient_id int, qty_required decimal(12,4)")
    made = fifo.demand_lines(items, recipe, orders)
    assert rows(made) == [(3, 1, 1, Decimal("21.0003"))]
    above = made._jdf.queryExecution().sparkPlan().toString().split("Generate")
    assert len(above) == 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fifo.demand_lines(items, recipe, orders)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan.split("Generate")[0]


@pytest.mark.parametrize("gathered", [10**6, 1])
def test_groups_are_closed_and_not_made_by_location(spark, monkeypatch, gathered):
    """Keys that orders link are one group in either form, those that none links stay apart; no location is one task."""
    monkeypatch.setattr(fifo, "GATHERED", gathered)
    # Location 1 links its keys in a chain, order 100 links locations 1 and 2, and location 3 stands alone.
    lines = [(1, i + s, i) for i in range(6) for s in (0, 1)] + [(1, 0, 100), (2, 5, 100), (3, 1, 101), (3, 2, 102)]
    made = fifo._grouped(spark.createDataFrame(lines, "restaurant_id int, ingredient_id int, order_id long").repartition(3))
    groups = {}
    for r in made.collect():
        groups.setdefault(r["group"], set()).add((r["restaurant_id"], r["ingredient_id"]))
    assert sorted(map(sorted, groups.values())) == [[(1, i) for i in range(7)] + [(2, 5)], [(3, 1)], [(3, 2)]]
    assert made.count() == len(lines)


def test_finalising_walks_the_axis_once(spark, monkeypatch):
    """Movements, batches and dishes read one stored axis."""
    from tavola.operators import inventory as inv

    made = []
    segments = fifo.segments
    monkeypatch.setattr(inv, "segments", lambda *a, **k: made.append(1) or segments(*a, **k))
    orders = spark.createDataFrame([(1, 7, "served", False, None, None), (2, 7, "served", False, None, None)],
        "id long, created_by_user int, status string, is_finalized boolean, completed_at timestamp_ntz, completed_by_user int")
    dishes = spark.createDataFrame([(5, 1)], "id int, restaurant_id int")
    recipe = spark.createDataFrame([(5, 1, Decimal(1))], "dish_id int, ingredient_id int, qty_required decimal(12,4)")
    got = inv.finalise_all(orders, needs(spark, [(1, 4), (2, 3)]), lots(spark, [(9, 5, DAY, True)]), dishes, recipe, dt.datetime(2025, 1, 2))
    assert rows(got["orders"], "id", "is_finalized") == [(1, True), (2, False)]
    assert rows(got["movements"], "batch_id", "change_qty", "related_order_id") == [(9, Decimal(-4), 1)]
    assert rows(got["batches"], "id", "qty", "active") == [(9, Decimal(1), True)] and rows(got["dishes"], "id", "is_available") == [(5, True)]
    assert made == [1] and "axis" in str(got["movements"].inputFiles())
