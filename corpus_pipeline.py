"""From documents to training shards: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir). ``run`` applies them in order; what a
stage returns is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dotweave.llm import bagminhash, mixing, quality, shards, templates
from dotweave.llm.common import shared_folder, table
from dotweave.llm.queries import document_path, tokenizer_path, training_part

#: Sequences that the last stage shuffles among themselves; the mix holds from one such window to the next.
WINDOW = 4096


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, table(spark, sf_dir, "labels"), "source", document_path(), part=training_part())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.remove(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, grow=False)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.sequences(docs, tokenizer_path("byte_bpe_50k.tiktoken"), window=WINDOW)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID / binary output", token_shards),
]

#: The classifier, the signatures and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            shards.release(spark, f"{folder}/{k - 1}")  # the shards are written
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            shards.release(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
