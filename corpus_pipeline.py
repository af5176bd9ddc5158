"""Training corpus from raw documents: language, near copies, leaks, mix, training order.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read back as
the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, language, mixing, simhash, training_order
from riskloom.llm.tables import free_name, keep_rows
from riskloom.session import shared_folder
from suite.registry import query


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter: no language can be told for them.

    Where no row has a language to learn from, nothing can be predicted and every text with a letter stays.
    """
    model, found = language.learn(docs), free_name(docs, "found")
    if not model.languages:
        return docs.where(F.col("text").rlike(language.LETTER))
    named = language.with_language(docs, model, found)
    return named.where(F.col(f"{found}.lang_pred") != language.NONE).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Documents without an id link with nothing and stay.
    """
    groups = simhash.near_duplicates(docs)
    kept = keep_rows(docs, groups.where("doc_id = component_id").select("doc_id").distinct())
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    benchmark, found = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), free_name(docs, "leaks")
    return decontaminate.with_leaks(docs, benchmark, found).where(F.size(found) == 0).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def training_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards; returns the row of every slot, read back from them."""
    return training_order.materialised_order(docs, shard_records=8192, stored=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mix", mixed),
    ("training_order", training_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# A classifier, 64-bit shingle hashes, edit distances within texts and a tokenizer are beyond SQL:
# tests hold the result against brute force.
ORACLE_SQL = None
query("pipeline", ORACLE_SQL)(run)
