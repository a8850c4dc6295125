"""Budgets of a tree and prefixes of epochs."""

import duckdb
from pyspark.sql import functions as F

from tavola.llm import mixing
from tests.conftest import rows

LEVELS = ["mix_d", "mix_l"]


def budgets(spark, leaves, weights, share=(1, 1), epochs=1):
    df = spark.createDataFrame(leaves, "mix_d string, mix_l string, _tokens long")
    return {(r[0], r[1]): r["_budget"] for r in mixing.leaf_budgets(df, LEVELS, weights, share, epochs).collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 500), ("b", "x", 500), ("b", "y", 500)]
    # 755: x of a lacks most of its share, y of a takes what x leaves, b is untouched
    got = budgets(spark, leaves, [{}, {}], (1, 2))
    assert got["a", "x"] == 10 and got["a", "y"] in (367, 368) and got["b", "x"] + got["b", "y"] == 755 - 10 - got["a", "y"]
    short = [("a", "x", 10), ("a", "y", 20), ("b", "x", 500), ("b", "y", 500)]
    got = budgets(spark, short, [{}, {}], (1, 2))
    assert got["a", "x"] == 10 and got["a", "y"] == 20 and got["b", "x"] + got["b", "y"] == 515 - 30


def test_weights_and_zero(spark):
    leaves = [("a", "x", 1000), ("b", "x", 1000), ("c", "x", 1000)]
    assert budgets(spark, leaves, [{"a": 3, "c": 0}, {}], (1, 3)) == {("a", "x"): 750, ("b", "x"): 250, ("c", "x"): 0}
    assert budgets(spark, leaves, [{}, {}], (9, 1), 2) == {(k, "x"): 2000 for k in "abc"}


def docs(spark):
    made = [(i, "w " * (1 + i % 7) if i % 11 else None, "en" if i % 3 else None, f"src{i % 4}") for i in range(300)]
    made += [(7, "same id other words", "en", "src1"), (7, "same id other words", "en", "src1"), (None, "no id", "en", "src0"), (5, "", "de", None)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string")


def test_mix_equals_sql(spark, tmp_path):
    df = docs(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    weights, options = [{"src0": 3}, {"en": 2}], {"share": (3, 2), "max_epochs": 4, "seed": 5}
    got = mixing.mix(df, {"s": F.col("source"), "l": F.col("lang")}, weights, **options)
    got = got.select("doc_id", "mix_s", "mix_l", "mix_epoch", "mix_tokens")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    sql = mixing.mix_sql({"s": "source", "l": "lang"}, weights, **options)
    want = sorted(con.execute(sql).fetchall(), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(got) == want and len(want) > 300


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark).limit(0), {"s": F.col("source")}, [{}]).count() == 0
    clash = docs(spark).withColumn("mix_tokens", F.lit("old"))
    made = mixing.mix(clash, {"s": F.col("source")}, [{}], share=(9, 1), max_epochs=1)
    assert made.count() == clash.count() and made.columns.count("mix_tokens") == 1 and made.schema["mix_tokens"].dataType.typeName() == "long"


def test_excluded_leaves_are_no_capacity(spark, tmp_path):
    """Weight 0 at the lower level: what is asked for is given, in the operator and in the SQL."""
    leaves = [("a", "x", 100), ("a", "y", 100), ("b", "x", 300), ("b", "y", 300)]
    assert budgets(spark, leaves, [{}, {"y": 0}], (1, 2)) == {("a", "x"): 100, ("a", "y"): 0, ("b", "x"): 300, ("b", "y"): 0}
    made = [(f"{d}{l}{n}", "w", l, d) for d, l, k in leaves for n in range(k)]
    df = spark.createDataFrame(made, "doc_id string, text string, lang string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    got = mixing.mix(df, {"s": F.col("source"), "l": F.col("lang")}, [{}, {"y": 0}], (1, 2), 1)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    sql = mixing.mix_sql({"s": "source", "l": "lang"}, [{}, {"y": 0}], (1, 2), 1, 1)
    assert got.count() == len(con.execute(sql).fetchall()) == 400


def budgets_by_hand(leaves, weights, total, epochs):
    """The tree filled by halving steps of one token: each token goes to the child with least use per weight."""
    def cap(path):
        return sum(t * epochs for *p, t in leaves if tuple(p[: len(path)]) == path and all(w.get(k, 1) for w, k in zip(weights, p)))

    def fill(path, budget):
        if len(path) == len(weights):
            return {path: budget}
        names = sorted({p[len(path)] for *p, _ in leaves if tuple(p[: len(path)]) == path})
        used = dict.fromkeys(names, 0)
        for _ in range(budget):
            open_ = [n for n in names if used[n] < cap((*path, n))]
            if not open_:
                break
            best = min(open_, key=lambda n: (used[n] / weights[len(path)].get(n, 1), n))
            used[best] += 1
        return {k: v for n in names for k, v in fill((*path, n), used[n]).items()}

    return fill((), total)


def test_budgets_of_two_levels_equal_brute_force(spark):
    leaves = [("a", "x", 10), ("a", "y", 40), ("a", "z", 9), ("b", "x", 70), ("b", "z", 30), ("c", "y", 25)]
    for weights in ([{"a": 3}, {"x": 2}], [{"b": 0}, {"z": 0}], [{"c": 5}, {"y": 0, "x": 4}]):
        total = sum(t for *_, t in leaves) // 2
        got, want = budgets(spark, leaves, weights, (1, 2)), budgets_by_hand(leaves, weights, total, 1)
        assert all(abs(got[k] - want[k]) <= 2 for k in want), (weights, got, want)
