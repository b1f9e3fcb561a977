"""One query for each operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchwork.llm.alignment import token_alignment
from catchwork.llm.licenses import fit as fit_licenses
from catchwork.llm.licenses import license_scan
from catchwork.llm.mixing import mix_sources
from catchwork.llm.negatives import hard_negatives
from catchwork.llm.packing import pack_documents
from catchwork.llm.phrases import repeated_passages
from catchwork.llm.quality import fit, quality_rules
from catchwork.llm.secrets import find_secrets
from catchwork.llm.sharding import shard_documents
from catchwork.llm.simhash import simhash_groups
from catchwork.llm.topk import top_k
from catchwork.llm.vectors import vector_groups
from catchwork.llm.warc import archived_pages

#: Target weights by name for each level of the tree; others have weight 1.
MIX_WEIGHTS = {"domain": {"domain0": 2.0, "domain1": 1.0}, "lang": {"en": 4.0, "de": 2.0}, "source": {"src0": 0.5}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op10_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), window=35)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality_rules(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_low", "kept")


def op2_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "merge_pos")


def op6_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op1_balanced_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS).drop("text_hash")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan(docs, fit_licenses(docs))


def op11_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(_table(spark, sf_dir, "documents"))
