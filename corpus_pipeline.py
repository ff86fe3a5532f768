"""The corpus pipeline: rules, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir); its result, written as Parquet, is the next one's docs. All
but the last return the columns of ``documents``; other columns of docs, whatever their names, are
left out. Very long texts go through whole. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality_rules import keep_good
from loomgraph.llm.secret_scan import redact_secrets
from loomgraph.llm.simhash import drop_near_copies
from loomgraph.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text; null for a null text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Repeated rows stay or go alike; null ids stay null."""
    return keep_good(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of smallest id, null ids last; of repeated rows one stays. Null texts link with each other and with texts without words."""
    return drop_near_copies(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that start anywhere else too go; the documents stay, repeated rows among them. Null texts stay null."""
    return _measured(remove_repeats(docs.select(*COLUMNS)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; the documents stay, repeated rows among them. Null texts stay null."""
    return _measured(redact_secrets(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. Null texts are as empty ones: the end alone. Repeated rows have pieces of their own."""
    return pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

#: SimHash, the randomness battery and byte-pair merging have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
