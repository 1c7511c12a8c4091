"""The corpus pipeline: documents through the stages in order, each written before the next reads it.

A stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns the columns of ``documents``; the
last returns the token ids of the mixed corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.bpe import encoded
from siltmark.llm.lsh_forest import one_of_each_group
from siltmark.llm.mixing import mix
from siltmark.llm.paragraph_dedup import without_repeats
from siltmark.llm.quality_rules import quality_verdicts
from siltmark.llm.text import written
from siltmark.plans.registry import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Learning, near duplicates and tokenization have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    return quality_verdicts(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return one_of_each_group(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs that an earlier document has; a document that loses all keeps its row with what is left."""
    out = without_repeats(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests of ids and of the decoded text."""
    out = encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), texts=False)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
