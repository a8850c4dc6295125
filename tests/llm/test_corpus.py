"""Registered queries against their SQL, and the pipeline stage by stage."""

import hashlib

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from tavola.llm import bpe, mixing, queries, toxicity
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert compare(spark, connect(DATA), name, DATA).startswith("ok")


def test_one_query_for_each_operator():
    found = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert found == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()


def test_pipeline(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    source = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}

    model = toxicity.train(*zip(*[(source[i]["text"], y) for i, y in sorted(labels.items()) if i in source and y in (0, 1)]))
    score = dict(zip(source, model.scores([r["text"] for r in source.values()], {})))
    assert set(kept[0]) == {i for i, s in score.items() if s < corpus_pipeline.TOXIC}

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(r["text"]) for i, r in kept[0].items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert set(kept[1]) == {i for i, r in root.items() if i == r}
    assert set(kept[2]) == set(kept[1]) and set(kept[3]) <= set(kept[2])
    own = bpe.WordBpe(open(queries.BPE_FILE, encoding="utf-8").read())
    for i, r in kept[4].items():
        assert hashlib.sha256(r["ids"]).digest() == hashlib.sha256(own.encode(kept[3][i]["text"])).digest()
    assert mixing.WORD and all(r["n_chars"] == len(r["text"]) for r in kept[2].values())
