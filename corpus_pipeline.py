"""From raw documents to token ids: the stages of a training corpus, each of them one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`; the last gives the ids of each document that is left.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from chronolith.llm.common import read_table, remove_at_exit, remove_folder, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.keep_one_of_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays; similarity is verified by shingles of five words."""
    return simhash.keep_one_of_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark within its error budget go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of the text that they decode to."""
    vocabulary = bpe.packed_file(public_tokenizers.path("byte_bpe_50k.json"))
    decoded = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]

#: Languages, fingerprints and ids can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is written to the shared folder named in spark.checkpoint.dir.

    A stage's rows go as soon as the next stage's are written, those that the last stage reads at the end of the process.
    """
    at, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", read_table(spark, sf_dir, "documents")
    remove_at_exit(spark, at)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove_folder(spark, f"{at}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
