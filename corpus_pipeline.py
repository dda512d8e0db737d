"""Corpus pipeline: quality rules, language ID, line dedup, near-dedup by SimHash trees and shingle similarity, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.language_id import UNKNOWN, fold_of, identify, learn_profiles
from quillspark.llm.line_templates import drop_recurring_lines
from quillspark.llm.near_copies import keep_one_similar
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality_rules import quality_rules
from quillspark.llm.shared import stored

# A text further than this from every profile is of no known language; prose scores 0.5 and more.
LEAST_SCORE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    n_chars = F.length("text").cast("long")
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that the rules reject: null, empty and short texts among them."""
    judged = quality_rules(docs).filter("kept")
    return documents(judged.drop("text").withColumnRenamed("clean_text", "text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents of no known language go.

    Those are texts without letters, null or empty ones included, and texts that score under LEAST_SCORE.
    """
    learned = docs.filter(~F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)))
    said = identify(docs, learn_profiles(learned))
    return documents(said.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document holds go; a document stays, if need be with an empty text."""
    return documents(drop_recurring_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group joined by a similarity of 0.8 or more, in runs of five words.

    SimHash fingerprints in sharded BK-trees find the pairs, exact Jaccard decides.
    Equal rows are one group, and so are all texts without words; the smallest doc_id stays, null ids last.
    """
    return documents(keep_one_similar(docs, least=0.8, shingle=5))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts in windows of 1024 ids; null and empty texts are their end id alone, rows are packed one by one."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_dedup", near_dedup), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
