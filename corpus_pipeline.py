"""Corpus preparation: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, langid, mixing, neardup, packing
from weftgraph.llm.common import fresh_dir, table
from weftgraph.llm.registry import tokenizer_path
from weftgraph.session import attach


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose predicted language scores below ``langid.MIN_SCORE``, go."""
    attach(spark)
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    attach(spark)
    return neardup.keep_one_of_each(docs, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of bytes for all sources."""
    attach(spark)
    return mixing.poisson_mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their place in sequences of 4096 tokens."""
    attach(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: language models, MinHash and tokenizers are beyond SQL; tests hold stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
