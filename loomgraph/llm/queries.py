"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .byte_bpe import encode_documents
from .classifier import score_documents, train_on
from .embedding_dedup import embedding_groups
from .lm_scoring import score_documents as score_likelihood
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack_documents
from .quality_rules import RepetitionRules, repetition_coverage
from .secret_scan import find_secrets
from .sharding import interleave_shards
from .simhash import simhash_groups
from .spelling import spelling_variants
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: equal counts, each shard with the mixture of sources. Null text: size 8, crc32 of no bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _docs(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    out = interleave_shards(docs, 24, tie_breaks=[F.col("size"), F.col("text_crc32")])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_docs(spark, sf_dir)).drop("found")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_docs(spark, sf_dir)).drop("kept_text")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(_docs(spark, sf_dir), path, public_tokenizers.PATTERN, digests=True)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RepetitionRules()
    out = repetition_coverage(_docs(spark, sf_dir), rules=rules)
    cover = [F.col("dup_ngram_chars")[i].alias(f"dup_{n}gram_chars") for i, (n, _) in enumerate(rules.max_ngram_chars_pct)]
    return out.select(*[c for c in out.columns if c != "dup_ngram_chars"], *cover)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_docs(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on rows whose crc32(doc_id as text) mod 5 is not 0; the others are held out."""
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train_on(docs, labels.where(fold != 0))
    held_out = F.coalesce(fold == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt on rows whose crc32(doc_id as text) mod 7 is not 2; those for which it is are held out. Null ids are neither."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    held_out = F.coalesce(fold == 2, F.lit(False))
    out = score_likelihood(_docs(spark, sf_dir), fold != 2)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return align_tokenizers(_docs(spark, sf_dir), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).drop("n_overlaps", "aligned")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_secret_scan,
        op3_substring_dedup,
        op4_byte_bpe,
        op5_embedding_dedup,
        op6_quality_rules,
        op7_packing,
        op8_simhash,
        op9_token_counts,
        op10_quality_classifier,
        op11_lm_scoring,
        op12_spelling_variants,
        op13_alignment,
    )
}

