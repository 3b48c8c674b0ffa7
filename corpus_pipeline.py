"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing, sharding.

Each stage reads what the one before has kept, written as Parquet in the shared folder in between.

- language: documents without a language (`und`: null text or no letter) go.
- near_dedup: of each group of near-duplicates (five words, 0.8 or more) the document with the least doc_id stays;
  rows that repeat a doc_id stay or go together.
- decontamination: documents that hold a benchmark item go.
- mixing: each row stays as often as the mix takes it: not at all, once or twice.
- sharding: adds virtual_slot and shard to every row; the slot map is stored in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh_path, table
from textloom.llm.decontamination import without_benchmark
from textloom.llm.language_id import LanguageModel, with_language
from textloom.llm.mixing import mixed_documents
from textloom.llm.near_dedup import BROADCAST_IDS, near_duplicates
from textloom.llm.sharding import assign, build_map

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs, LanguageModel.fit(docs.select("doc_id", "lang", "text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = cut(near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())
    # so few ids go to every worker and no text moves; more are joined by a shuffle
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slot_map, _ = build_map(docs, SHARDS, fresh_path(spark, "slot-map"))
    return assign(docs, slot_map)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned models and hashes that SQL lacks: tested against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
