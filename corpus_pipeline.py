"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns of `documents`, whatever they are.

Defined cases: rows with a null or empty text fail the quality rules and go; so do texts of fewer than ten words. A null id or
source is kept; the largest id stays of equal texts and the smallest of near ones, where a null counts as no id. Repeated rows become
one in the second stage. Very long texts are read whole by all stages. An empty table gives an empty result.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame

from lagwise.llm import bpe, exact, mixing, rules, simhash
from lagwise.session import shared_dir


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the posterior of the weak rules keep."""
    return rules.keep_good(docs)


def exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.dedup(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked at 3 bits over 3-word shingles: the one with the smallest doc_id."""
    return simhash.dedup(docs, shingle=3, radius=3)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates of their sources."""
    return mixing.mix(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the mixed documents, encoded and decoded."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("mix_sources", mix_sources), ("encode", encode),
]

# Posteriors, links within a bit distance and merges of token pairs are beyond plain SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps lies in the shared folder until the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return rows
        rows.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
