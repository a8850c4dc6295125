import pytest
from pyspark.sql import functions as F

from tavola.functions.stemming import has_all_stems, stem
from tavola.operators import wordindex
from tavola.operators.wordindex import build_index, search_index

# Words and stems of the published Russian sample, and English forms.
FORMS = {
    "вагона": "вагон", "вагонах": "вагон", "вагнера": "вагнер", "важная": "важн", "важнейшими": "важн",
    "важничал": "важнича", "важность": "важност", "вазах": "ваз", "валился": "вал", "печальнее": "печальн",
    "поверила": "повер", "мясом": "мяс", "мясо": "мяс", "борщ": "борщ", "щёки": "щек", "в": "в", "взгляд": "взгляд",
    "прочитавшись": "прочита", "бегающая": "бега", "молодость": "молод",
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "kiwis": "kiwi", "bus": "bus",
    "agreed": "agree", "feed": "feed", "plastered": "plaster", "hopping": "hop", "hoping": "hope", "conflated": "conflate",
    "sized": "size", "sing": "sing", "happy": "happi", "say": "say", "by": "by", "is": "is",
    "suppe2": "suppe2", "café": "café", "": "",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in FORMS], "w string")
    assert dict(df.select("w", stem(F.col("w")).alias("s")).collect()) == FORMS


TEXTS = [
    (1, "Борщ с мясом"), (2, "мясо, хлеб"), (3, None), (4, ""), (5, "Hopping cats"), (6, "cat hops; МЯСА"),
    (7, "the cats " * 50_000), (7, "борщи"), (None, "cats"), (8, "!!"),
]


@pytest.mark.parametrize("words,found", [
    ("мясо", {1, 2, 6}), ("CAT", {5, 6, 7}), ("cats hop", {5, 6}), ("борщ cat", {7}), ("нет", set()), ("", set()), ("мясо мясом", {1, 2, 6}),
])
def test_index_finds_what_the_scan_finds(spark, tmp_path, words, found):
    texts = spark.createDataFrame(TEXTS, "id long, t string")
    index = build_index(texts, "id", "t", str(tmp_path / "words"), buckets=4, parts=2)
    assert {r.id for r in search_index(texts, "id", index, words).collect()} == found
    scan = {r.id for r in texts.where(has_all_stems("t", words) & F.col("id").isNotNull()).collect()}
    assert scan == found - ({7} if words == "борщ cat" else set())  # the index joins the rows of one id


def test_search_reads_its_own_buckets(spark, tmp_path):
    texts = spark.range(500).select("id", F.concat(F.lit("word"), F.col("id")).alias("t"))
    index = build_index(texts, "id", "t", str(tmp_path / "words"), buckets=16, parts=2)
    found = index.search(spark, "word7 word7")
    assert [r.id for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().toString()
    scanned = plan[plan.index("== Physical"):]
    assert "PartitionFilters: [isnotnull(bucket" in scanned and "EqualTo(stem,word7)" in scanned


def test_empty_table(spark, tmp_path):
    texts = spark.createDataFrame([], "id long, t string")
    index = build_index(texts, "id", "t", str(tmp_path / "words"))
    assert index.search(spark, "cat").count() == 0


def test_texts_of_one_part_are_dealt_by_their_characters(spark, monkeypatch):
    """A file of texts may come as one part; cutting it is not the work of one task."""
    from tavola.operators import textweights

    monkeypatch.setattr(textweights, "CHARACTERS_PER_TASK", 10)
    texts = spark.createDataFrame([(i, "ones and twos") for i in range(20)] + [(90, None)], "id long, text string").coalesce(1)
    assert textweights.dealt(texts, "text").rdd.getNumPartitions() == 26
    assert textweights.dealt(texts.where("false"), "text").rdd.getNumPartitions() == 4
    for module, run in ((textweights, lambda: textweights.vocabulary(texts, "text")), (wordindex, lambda: wordindex.build_index(texts, "id", "text"))):
        seen = []
        monkeypatch.setattr(module, "dealt", lambda df, name, f=textweights.dealt: seen.append(name) or f(df, name))
        run()
        assert seen == ["text"]
        monkeypatch.undo()
