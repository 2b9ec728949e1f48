"""The queries of this subpackage, each over its whole table, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, extraction, hardneg, hilbert, langid, media, merkle, mixing, neardup, packing, pstable, quality, urlfilter
from weftgraph.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # alone, workers have room for more words than in the pipeline
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(), cache_words=500_000)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op4_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.encode_documents(table(spark, sf_dir, "documents")))


def op5_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op6_quality_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("at", "keep_at")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(hardneg.labelled(table(spark, sf_dir, "embeddings")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))


def op13_pstable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return pstable.neighbours(rows.select(rows["vec_id"].alias("id"), rows["embedding"].alias("vector")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_poisson_mixing": mixing.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_hard_negatives": hardneg.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
