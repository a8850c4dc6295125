"""Columns of a user that have the names an operator uses inside stay as they are."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tavola.llm import bpe, langid, minhash, mixing, pii, styletree, toxicity, viterbi
from tavola.llm.naming import free

INSIDE = [
    "_lang", "_bpe", "_pii", "_text", "_host", "_page", "_branches", "_end", "_epochs", "_s", "_cap", "_w", "_n", "_id", "key", "id",
    "node", "size", "n", "signature", "host", "page", "branches", "a", "b", "component", "_budget", "_tokens", "_key",
]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, f"the plain words of text {i} and others", "en" if i % 2 else "de", f"src{i % 3}") for i in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in INSIDE}).persist()


def languages(docs):
    return langid.predict(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def toxic(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


def pages(docs):
    return styletree.extract(docs.withColumn("url", F.lit("http://a.org/x")).withColumn("html", F.concat(F.lit("<p>"), "text", F.lit("</p>"))).withColumnRenamed("text", "old"))


OPERATORS = {
    "langid": languages,
    "bpe": lambda d: bpe.bpe_encode(d, public_tokenizers.path("word_bpe_49k.json")),
    "viterbi": lambda d: viterbi.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "mixing": lambda d: mixing.mix(d, {"s": F.col("source"), "l": F.col("lang")}, [{}, {}]),
    "toxicity": toxic,
    "minhash": minhash.deduplicate,
    "styletree": pages,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(docs, name):
    got = OPERATORS[name](docs)
    rows = got.select("doc_id", *INSIDE).collect()
    assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in INSIDE)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_a int, __A int")
    assert free(df, "_a", "_b", "_a") == ["___a", "_b", "____a"]
