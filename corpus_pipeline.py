"""A corpus pipeline from documents to token shards, one operator of ``pactlens.llm`` per stage.

Each stage takes the rows its predecessor kept, as reread from Parquet, and its decision
takes effect: texts without a language go, one document of each group of near copies stays,
documents with a benchmark passage go, sources are mixed to their weights (documents repeat),
and the rest becomes token shards, of which the last stage returns the digest.  The table of a stage
is deleted when its successor is written; the token shards, which are the output, stay.

Defined cases are those of the operators: a null or empty text has no letter and goes in the first
stage, an empty table gives no rows, repeated rows are copies of each other, further columns of
documents pass through up to the last stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from pactlens.functions.staging import scratch_folder  # noqa: E402
from pactlens.llm import decontaminate, language_id, mixing, parity_join, token_output  # noqa: E402
from pactlens.llm.common import forget, table  # noqa: E402

#: Near copies share at least this part of their shingles of five words.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.representatives(docs, width=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def output_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    token_output.write_token_shards(docs, path, "byte_bpe_50k.json", 2)
    return token_output.read_token_shards(spark, path)


STAGES = [
    ("language ID", detect_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", output_tokens),
]

#: The tokenizer of the last stage has no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # the next table is written whole
            forget(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
