"""Look-ups of hot keys and components with them."""

from tavola.operators import components as module


def test_hot_keys_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAST", 5)
    monkeypatch.setattr(module, "HOT", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 20), (3, 10), (4, 2)) for i in range(n)], "k long, i long")
    table = spark.createDataFrame([(k, k * 10) for k in (1, 2, 3, 4, 9)], "k long, v long")
    hot = module.hot_keys(rows, "k")
    assert hot == [1, 2] and module.hot_keys(rows, "k", 5) == []
    want = sorted(map(tuple, rows.join(table, "k").select("k", "i", "v").collect()))
    assert sorted(map(tuple, module.lookup(rows, "k", table, hot).select("k", "i", "v").collect())) == want


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAST", 5)
    monkeypatch.setattr(module, "thinned", lambda batches: batches)
    links = [(500, i) for i in range(40)] + [(600, i) for i in range(30, 60)] + [(700, 701), (702, 701)]
    got = dict(module.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    assert got == {**{i: 0 for i in range(60)}, 500: 0, 600: 0, 700: 700, 701: 700, 702: 700}
