"""From raw documents to packed training sequences, each stage one operator of ``rankeval.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankeval.llm import jaccard, mixing, packing, pii, quality
from rankeval.llm.queries import END_ID, table, tokenizer
from rankeval.sources.staging import scratch_path


def _counted(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), least_score=0.7)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, num=4, den=5)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.mask(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use that the mix makes of a document."""
    return _counted(mixing.mixed(docs, weights=(5, 2, 1), share=1.5, repeat=2))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.  Workers go on to other stages, so they keep fewer words."""
    return packing.pack(docs, tokenizer(), END_ID, capacity=4096, cached_words=300_000)


STAGES = [("quality", classify), ("near duplicates", deduplicate), ("personal data", mask), ("mixing", mix), ("packing", pack)]

#: A trained classifier decides what the first stage keeps; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return found
        found.write.parquet(path := scratch_path(spark, f"pipeline-{i}"))
        docs = spark.read.parquet(path)
    return docs
