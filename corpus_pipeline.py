"""A corpus pipeline of five stages: language ID, exact and near deduplication, passages, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents. Executors live on
from stage to stage, so each stage begins with the heap that others grew given back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release_heaps, table
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.language_id import accept_languages
from tidemark.llm.ngram_jaccard import jaccard_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.substring_dedup import passages, without_passages

SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    release_heaps(spark)
    return accept_languages(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    release_heaps(spark)
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies, that with the smallest doc_id."""
    release_heaps(spark)
    groups = jaccard_components(docs, SHINGLE_WORDS, *SIMILARITY)
    others = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "near-copies")
    release_heaps(spark)
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    release_heaps(spark)
    found = passages(docs)
    release_heaps(spark)
    return without_passages(docs, found)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training."""
    release_heaps(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("substring_dedup", passage_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
