"""Corpus pipeline: raw documents to mixed, encoded documents, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.

Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash fingerprints of
these shingles and covering masks draw the candidates, at nine bits; the thin SimHash operator's contract sets three-word
shingles and three bits.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanfold.llm import byte_bpe, language_id, mixing, near_copies, quality_rules
from spanfold.llm.common import read_table, shared_dir, ship, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the isolation forest; the threshold comes from `labels`."""
    return quality_rules.accepted(docs, read_table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or of which no language holds enough."""
    return language_id.accepted(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: SimHash candidates, then an exact check, also of what their radius leaves apart."""
    return near_copies.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that the sources meet their target weights."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the mix."""
    return byte_bpe.digest(docs, public_tokenizers.path(byte_bpe.VOCABULARY))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Forests, expectation-maximisation and components are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    folder, docs = shared_dir(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
