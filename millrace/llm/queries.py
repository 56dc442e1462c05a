"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe_codec import codec_digests
from millrace.llm.imatch import edited_likeness
from millrace.llm.media_gif import gif_features
from millrace.llm.ngram_join import ORACLE as JOIN_ORACLE
from millrace.llm.ngram_join import shingle_components
from millrace.llm.packing import pack_documents
from millrace.llm.quality import quality_scores
from millrace.llm.substring_dedup import ORACLE as SUBSTRING_ORACLE
from millrace.llm.substring_dedup import dedup_words
from millrace.llm.suffix_dedup import ORACLE as SUFFIX_ORACLE
from millrace.llm.suffix_dedup import dedup_bytes
from millrace.llm.token_counts import token_counts
from millrace.llm.warc import ORACLE as WARC_ORACLE
from millrace.llm.warc import crawl_of, header_text, resolve_revisits


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_words(_documents(spark, sf_dir).select("doc_id", "text"), keep=False)
    return made.select("doc_id", "removed.n_words", "removed.n_removed", "removed.kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(_documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_bytes(_documents(spark, sf_dir).select("doc_id", "text"), keep=False)
    return made.select("doc_id", "removed.n_bytes", "removed.n_removed", "removed.n_spans", "removed.kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(_documents(spark, sf_dir))


def op8_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_features(_documents(spark, sf_dir))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_documents(spark, sf_dir))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(crawl_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return resolved.withColumn("merged_headers", header_text("merged_headers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_packing, op3_ngram_join, op4_suffix_dedup, op5_token_counts, op6_quality, op7_bpe_codec, op8_media_gif, op9_imatch, op10_warc_revisits]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_ORACLE, "op3_ngram_join": JOIN_ORACLE, "op4_suffix_dedup": SUFFIX_ORACLE, "op10_warc_revisits": WARC_ORACLE}
