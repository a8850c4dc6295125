"""The corpus pipeline: toxic documents go, near-duplicates go but for one of each group,
personal data is replaced, sources are mixed to their weights, and texts become BPE ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next one. All stages but the last return the
columns of `documents`. A null or empty text passes every stage; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm import bpe, minhash, mixing, pii, toxicity
from tavola.llm.queries import BPE_FILE, DOMAIN_OF_SOURCE, PII_KEY, WEIGHTS
from tavola.session import shared_dir

#: Documents with this score or more go.
TOXIC = 0.5
#: All tokens that are left are asked for; a source is read at most twice.
MIX = {"share": (1, 1), "max_epochs": 2, "seed": 1}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, result="_score").where(F.col("_score") < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return minhash.deduplicate(docs).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text."""
    made = pii.pseudonymise(docs, PII_KEY, found="_found").withColumn("n_chars", F.length("text").cast("long"))
    return made.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by budget; one that is in two epochs comes twice."""
    levels = {"domain": F.expr(DOMAIN_OF_SOURCE), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, WEIGHTS, **MIX).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text."""
    return bpe.bpe_encode(docs.select("doc_id", "text"), BPE_FILE, decoded=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_copies),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
    ("BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; results between stages are written to the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
