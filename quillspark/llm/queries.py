"""Registered queries of the training-data operators, production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, lexical, line_templates, topk, url_filters
from .bpe import bpe_digests
from .fill_middle import fill_in_middle, restored
from .language_id import held_out_languages
from .lexical import ranked_search
from .line_templates import drop_recurring_lines
from .packing import pack_documents
from .quality_rules import quality_rules
from .shared import read_table
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .token_store import read_ids, write_ids
from .topk import exact_topk
from .url_filters import url_filter
from .warc import read_warc, write_warc


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), radius=3, shingle=3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read_table(spark, sf_dir, "embeddings"), k=10, query_every=100)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(read_table(spark, sf_dir, "pages"), min_bytes=0))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "n_lines", "n_dropped")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(read_table(spark, sf_dir, "documents"), seed=1, percent=90, spm_percent=20)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(read_table(spark, sf_dir, "documents"), window=13)
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_simhash, op3_quality_rules, op4_topk, op5_warc, op6_token_ids, op7_language_id, op8_packing, op9_line_templates, op10_bpe, op11_lexical_search, op12_fill_in_middle, op13_substring_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_url_filters": url_filters.oracle_sql(), "op4_topk": topk.ORACLE, "op9_line_templates": line_templates.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_fill_in_middle": fill_middle.ORACLE}
