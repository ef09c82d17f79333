"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source weights and token ids over the documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import bpe, mixing, neardup, quality, substrings
from tallymark.session import scratch_path

#: SQL has no XXH64 shingles, compact windows or byte-level BPE; the stages are tested against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No two documents whose five-word shingles have a Jaccard similarity of 0.8, found by SimHash fingerprints and by min-hash
    bands: the one with the smaller doc_id stays; rows without a doc_id stay.
    """
    return neardup.keep_first(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document with a smaller doc_id has as well."""
    return substrings.cut_repeats(docs, length_col="n_chars")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at nine tenths of the entropy of equal weights, in the smallest budget that takes every document once at
    least; documents of small sources come several times.
    """
    return mixing.mixed_documents(docs, target_entropy=0.9)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", good_documents),
    ("near-dedup", one_of_each_group),
    ("substring dedup", first_passages),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
