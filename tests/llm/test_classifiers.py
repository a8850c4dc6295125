"""Toxicity and language: kernel by definition, held-out accuracy, rows without text."""

import random
import zlib
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tavola.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.1"


def by_definition(s, t):
    total = 0.0
    for i in combinations(range(len(s)), toxicity.LENGTH):
        for j in combinations(range(len(t)), toxicity.LENGTH):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(24)]
    got = toxicity.similarity(words[:12], words[12:])
    for i, a in enumerate(words[:12]):
        for j, b in enumerate(words[12:]):
            norm = (by_definition(a, a) * by_definition(b, b)) ** 0.5
            assert got[i, j] == pytest.approx((by_definition(a, b) / norm) ** toxicity.POWER, abs=1e-5)


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    text = dict(zip(docs["doc_id"], docs["text"]))
    labels = pq.read_table(f"{FOLDER}/labels.parquet").to_pydict()
    return [(i, text[i], y) for i, y in zip(labels["doc_id"], labels["toxic"]) if i in text][:2500]


def test_toxicity_on_held_out_documents(labelled):
    train = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 5]
    test = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    model = toxicity.train([r[1] for r in train], [r[2] for r in train])
    score = model.scores([r[1] for r in test], {})
    wrong = [(r[2], s) for r, s in zip(test, score) if (s >= 0.5) != r[2]]
    assert len(wrong) <= 0.05 * len(test)
    plain, gapped, spaced, other = model.scores(["you idiot", "you id.iot", "you i d i o t", "the cat sat"], {})
    assert min(plain, gapped, spaced) >= 0.5 > other


def test_toxicity_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"word{i} you moron" if i % 2 else f"word{i} thing", 1) for i in range(40)] + [(41, None, 1), (42, "", 1), (43, "x" * 50_000, 1)],
        "doc_id long, text string, score int",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (2, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1] > 0.5 > got[2]
    assert got[41] == got[42] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_driver_holds_no_training_texts(spark, monkeypatch):
    """Training is a task's work, so the driver's memory does not grow with the texts; the model is the same."""
    docs = spark.createDataFrame([(i, f"word{i} you moron" if i % 2 else f"word{i} thing") for i in range(40)] + [(40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, toxic int")
    want = toxicity.train(*zip(*[(r["text"], r["doc_id"] % 2) for r in sorted(docs.collect())]))

    def refused(*_):
        raise AssertionError("trained by the driver")

    monkeypatch.setattr(toxicity, "train", refused)
    got = toxicity.fit(docs, labels)
    assert got.landmarks == want.landmarks and got.weights == pytest.approx(want.weights, abs=1e-6)
    assert (got.bias, got.slope, got.offset) == pytest.approx((want.bias, want.slope, want.offset))


def test_language_on_held_out_documents():
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()[:3000]
    train = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1][:1200]
    test = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    model = langid.train([r["text"] for r in train], [r["lang"] for r in train])
    names, score, rejected = model.predict([r["text"] for r in test])
    assert sum(a == r["lang"] for a, r in zip(names, test)) >= 0.97 * len(test)
    assert ((score >= 0) & (score <= 1)).all() and rejected.mean() < 0.1
    whole = " ".join(r["text"] for r in test[:50])
    parts = model.logits([whole])[0], model.logits([whole, "x"])[0][:1]
    assert abs(parts[0] - parts[1]).max() < 1e-6


def test_language_rows(spark):
    known = [(i, "der die und das nicht", "de") for i in range(30)] + [(100 + i, "the of and that not", "en") for i in range(30)]
    docs = spark.createDataFrame(known + [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "", None), (1003, "the of", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs.drop("lang"), model).collect()}
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1000]["score"] == 0 and got[1000]["rejected"]
    assert got[1003]["lang_pred"] == "en" and got[0]["lang_pred"] == "de"
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.where(F.lit(False)))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
