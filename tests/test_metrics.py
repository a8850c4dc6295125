"""Metrics against counting by hand, and the pieces under them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tavola.functions.ngrams import char_ngrams
from tavola.operators import metrics, textweights
from tavola.operators.running import running_total
from tests.conftest import rows


def scored(seed, n=300):
    rng = random.Random(seed)
    # A third of the rows share one score.
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.4)
        score = 0.5 if rng.random() < 0.33 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * label, 0.2))), 3)
        out.append((label, score))
    return out


def auc_by_pairs(data):
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)


def average_precision(data):
    total, last, out = sum(y for y, _ in data), 0.0, 0.0
    for t in sorted({s for _, s in data}, reverse=True):
        tp = sum(y for y, s in data if s >= t)
        n = sum(1 for _, s in data if s >= t)
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_areas(spark, seed):
    data = scored(seed)
    df = spark.createDataFrame(data, "label int, score double")
    got = metrics.curve_areas(metrics.score_counts(df, parts=7)).first()
    assert got["roc_auc"] == pytest.approx(auc_by_pairs(data))
    assert got["pr_auc"] == pytest.approx(average_precision(data))


def test_sweep(spark):
    data = scored(3)
    df = spark.createDataFrame(data, "label int, score double")
    sweep = {r["threshold"]: r for r in metrics.threshold_sweep(df).collect()}
    tried = metrics.sweep_thresholds()
    assert sorted(sweep) == tried and len(tried) == 50 and tried[0] == 0.1 and tried[-1] == 0.9
    f1 = {}
    for t in tried:
        tp = sum(y for y, s in data if s >= t)
        fp = sum(1 - y for y, s in data if s >= t)
        fn = sum(y for y, s in data if s < t)
        assert (sweep[t]["tp"], sweep[t]["fp"], sweep[t]["fn"]) == (tp, fp, fn)
        f1[t] = 2 * tp / (2 * tp + fp + fn)
    best = metrics.best_threshold(metrics.threshold_sweep(df)).first()
    assert best["threshold"] == max(tried, key=lambda t: (f1[t], -t))


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    got = metrics.evaluate(df.withColumn("predicted", F.lit(1))).first()
    assert got["roc_auc"] is None and got["precision"] == 1.0 and got["mcc"] == 0.0


def test_running_total_over_levels(spark):
    rng = random.Random(5)
    data = [(rng.choice("aab"), i, rng.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(7)
    levels = {"_a": F.floor(F.col("i") / 50), "_b": F.floor(F.col("i") / 7)}
    got = {r["i"]: r["t"] for r in running_total(df, ["k"], levels, [F.asc("i")], {"t": F.col("v")}).collect()}
    sums, want = {}, {}
    for k, i, v in data:
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert got == want


@pytest.mark.parametrize("text", ["abcdef", "ab", "", "A  b\t\nc", "Борщ🍲 суп"])
def test_ngrams(spark, text):
    import re

    clean = re.sub(r"\s\s+", " ", text.lower())
    want = [clean[i : i + n] for n in (3, 4, 5) for i in range(len(clean) - n + 1)]
    got = spark.createDataFrame([(text,)], "t string").select(char_ngrams(F.col("t"))).first()[0]
    assert got == want


def test_weights(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abcx abc"), (3, "zzz")], "id int, t string")
    vocab = {r["gram"]: r["df"] for r in textweights.vocabulary(df, "t").collect()}
    assert vocab == {"abc": 2}
    assert rows(textweights.weights(df, "id", "t")) == [(1, "abc", 1, 1.0), (2, "abc", 2, 1.0)]
    # A term of every text is left out when the share is bounded.
    same = spark.createDataFrame([(i, "abc") for i in range(3)], "id int, t string")
    assert textweights.vocabulary(same, "t").isEmpty()


def test_ngrams_of_weights_do_not_move(spark, monkeypatch):
    """Whatever the size limit of automatic broadcasts, only texts and the vocabulary are shuffled; beyond `SENT`, the same result."""
    df = spark.createDataFrame([(i, f"text {i % 7} of {i % 3}") for i in range(60)] + [(60, None)], "id long, t string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = textweights.weights(df, "id", "t")
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        want = rows(sent)
        monkeypatch.setattr(textweights, "SENT", 0)
        met = textweights.weights(df, "id", "t")
        assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
        assert [r[:3] for r in rows(met)] == [r[:3] for r in want] and len(want) > 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_weights_are_made_of_numbered_ngrams(spark):
    """Texts are cut in numpy; rows of one key are one text, a null key is in no count of texts."""
    df = spark.createDataFrame(
        [(1, "ABcd  ef"), (1, "abc"), (2, "abc😀 abc"), (None, "abc bcd"), (None, "bcd"), (3, None), (4, ""), (5, "bcd")], "id int, t string"
    )
    made = textweights.weights(df, "id", "t")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "ArrowEvalPython" in plan
    got = {(r["id"], r["gram"]): (r["tf"], r["weight"]) for r in made.collect()}
    one, two = (math.log((1 + 7) / (1 + n)) + 1 for n in (2, 2))  # abc: keys 1 and 2; bcd: keys 1 and 5
    want = {(1, "abc"): (2, 2 * one), (1, "bcd"): (1, two), (2, "abc"): (2, 2 * one), (None, "abc"): (1, one), (None, "bcd"): (2, 2 * two), (5, "bcd"): (1, two)}
    length = {k: sum(v * v for (i, _), (_, v) in want.items() if i == k) ** 0.5 for k, _ in want}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1] / length[k[0]]) < 1e-12 for k in want)
    assert textweights.weights(df.where("false"), "id", "t").count() == 0
