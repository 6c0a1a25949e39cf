"""Queries and SQL of this subpackage's operators, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.llm import (
    byte_bpe,
    decontamination,
    fill_in_middle,
    language_id,
    licenses,
    near_dup,
    prefix_trie,
    quality_bayes,
    quality_rules,
    secrets,
    sentencepiece_fst,
    toxicity,
    warc,
)
from jobacct.llm.common import fold_1_of_3, table
from jobacct.llm.oracle import SQL

#: Where the public tokenizer files lie; a parameter of the SentencePiece operator.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks that a worker remembers in the query, where it shares the executor with no other stage (the pipeline keeps the default).
SENTENCEPIECE_CACHE = 600_000
BYTE_BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, d, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers")


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    r = decontamination.scan(spark, table(spark, d, "documents"), table(spark, d, "benchmark"))
    return r.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    r = toxicity.score_documents(spark, table(spark, d, "documents"), table(spark, d, "labels"), keep=["doc_id"])
    return r.select("doc_id", fold_1_of_3().alias("held_out"), "score", (F.col("score") >= toxicity.PREDICT).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(spark, table(spark, d, "documents"), keep=["doc_id"])


def op5_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentencepiece_fst.encode_decode(docs, sentencepiece_fst.read_model(spark, SENTENCEPIECE_MODEL), keep=["doc_id"], checked=True, cache=SENTENCEPIECE_CACHE)


def op6_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    r = near_dup.near_duplicates(spark, table(spark, d, "documents"), k=4)
    return r.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_bayes.score_quality(spark, table(spark, d, "documents"), table(spark, d, "labels"), F.col("source"), F.col("lang"))


def op8_language(spark: SparkSession, d: str) -> DataFrame:
    r = language_id.identify(spark, table(spark, d, "documents"), keep=["doc_id"])
    return r.select("doc_id", fold_1_of_3().alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, d, "documents"))


def op10_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.derivatives(table(spark, d, "pages"))


def hundreds(c: Column) -> tuple[Column, Column]:
    """The conversation at the last full hundred, and crc32 of the decimal id modulo 6 of its turns."""
    return c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    nodes = prefix_trie.build(spark, table(spark, d, "conversations"), shared=hundreds).nodes
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    r = fill_in_middle.fill_in_middle(table(spark, d, "documents"), keep=["doc_id"])
    return r.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(sentencepiece_fst.read_model(spark, public_tokenizers.path(BYTE_BPE_RANKS)))
    r = byte_bpe.encode_decode(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return r.select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_decontamination, op3_toxicity, op4_licenses, op5_sentencepiece, op6_near_duplicates, op7_quality, op8_language, op9_quality_rules, op10_warc, op11_prefix_trie, op12_fill_in_middle, op13_byte_bpe)
}

__all__ = ["QUERIES", "SQL"]
