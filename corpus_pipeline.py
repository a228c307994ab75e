"""A training corpus from raw documents, in stages; each writes its documents and the next one reads them.

Toxic documents go; runs of lines that occurred before are deleted; one document of each group of near-duplicates
stays; words that belong to benchmark passages are cut out; what is left is encoded. A document goes with its last line
or word, if a stage takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlake.llm import bpe, fm_index, line_dedup, minhash, toxicity
from firmlake.llm.queries import vocabulary
from firmlake.llm.registry import table
from firmlake.session import settle


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_index.remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256``."""
    return bpe.tokens(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("bpe", encode),
]

ORACLE_SQL = None  # a trained classifier decides which documents the stages see


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
