"""From raw documents to token ids: filter, de-duplicate, decontaminate, replace personal data, encode.

Each stage works on all that its predecessor kept, as a table of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, quality_rules, sentencepiece_agenda, simhash, surrogates
from pathloom.llm.common import discard, new_path, table
from pathloom.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    ship(spark)
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_score(docs, model, "_score").where(F.col("_score") >= quality_rules.CUT).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    ship(spark)
    return simhash.one_of_each(docs, 5, 0.8).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in its words or re-parameterised, go."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; the length is that of the new text."""
    ship(spark)
    return surrogates.replace_entities(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, the end id last."""
    ship(spark)
    encoded = sentencepiece_agenda.encode(docs, sentencepiece_agenda.default_model())
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: SimHash, surrogates and encoding are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
