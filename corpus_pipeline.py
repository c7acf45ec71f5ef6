"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, mixing, near_dup, packing, toxicity
from lexiloom.llm._store import stage
from lexiloom.llm.queries import tokenizer_file
from lexiloom.sources.files import dealt

#: Target shares of tokens by the domain that labels.quality marks.
TARGETS = {"good": 0.95, "poor": 0.05}


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a significant toxic score go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels, "toxic"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the largest id stays."""
    return near_dup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor documents are thinned to their target share of tokens; good ones stay whole."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))
    return mixing.mixed(docs, labelled, TARGETS, max_rate=1.0, anchor="good")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.packed(docs, tokenizer_file())


STAGES = [("toxicity", toxic_out), ("exact dedup", copies_out), ("n-gram jaccard join", near_copies_out), ("mixing", mix), ("packing", pack)]

#: Learned models and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
