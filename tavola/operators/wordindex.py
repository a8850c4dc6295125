"""Keyword search over posting lists: rows of (stem, id), stored by bucket of the stem.

The index is a table of Parquet files in one folder per bucket, sorted by stem. A search opens
the buckets of its own stems alone, and in them the row groups that can hold a stem. A stem that
every text has is dealt over `parts` tasks and files of its bucket by id, so no task gets it whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tavola.functions.stemming import word_stems
from tavola.operators.textweights import dealt
from tavola.session import shared_dir


@dataclass(frozen=True)
class WordIndex:
    """A written index: its folder, its number of buckets, and (bucket, stem, id) as `schema`."""

    path: str
    buckets: int
    schema: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def search(self, spark: SparkSession, keywords: str) -> DataFrame:
        """(id) of texts that have a form of every word of `keywords`, once each.

        Keywords without a word find nothing.
        """
        stems = spark.range(1).select(F.explode(word_stems(F.lit(keywords))).alias("stem"))
        # One row per keyword: what the user typed, however large the index is.
        wanted = [tuple(r) for r in stems.select(_bucket("stem", self.buckets), "stem").collect()]
        names = sorted({name for _, name in wanted})
        mine = F.col("bucket").isin(*{number for number, _ in wanted}) & F.col("stem").isin(*names)
        found = self.postings(spark).where(mine if names else F.lit(False))
        return found.groupBy("id").agg(F.size(F.collect_set("stem")).alias("n")).where(F.col("n") == len(names)).select("id")


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")


def build_index(
    texts: DataFrame, id: str, column: str, path: str | None = None, buckets: int = 64, parts: int = 16
) -> WordIndex:
    """Write the index of `texts` to `path`, a new folder of the shared one when not given.

    Null ids and texts without a word have no postings. An id with several rows has the words
    of all of them.
    """
    path = path or f"{shared_dir(texts.sparkSession)}/words-{uuid.uuid4().hex}"
    rows = dealt(texts.where(F.col(id).isNotNull()).select(id, column), column).select(F.explode(word_stems(column)).alias("stem"), F.col(id).alias("id"))
    rows = rows.select(_bucket("stem", buckets), "stem", "id")
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    rows.repartition("bucket", part).sortWithinPartitions("bucket", "stem", "id").write.partitionBy("bucket").parquet(path)
    kind = dict(rows.dtypes)["id"]
    return WordIndex(path, buckets, f"stem string, id {kind}, bucket int")


def search_index(texts: DataFrame, id: str, index: WordIndex, keywords: str) -> DataFrame:
    """Rows of `texts` that the index finds."""
    return texts.join(index.search(texts.sparkSession, keywords).withColumnRenamed("id", id), id, "left_semi")
