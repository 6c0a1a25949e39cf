"""The corpus pipeline: quality rules, near duplicates, benchmark passages,
secrets, token ids. ``STAGES`` lists (name, function); each function takes
(spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents``; the last returns all of them but the text, then ids, n_ids, decoded.

Defined results: documents without words fail the quality rules. Rows that
share a doc_id and a text are one document to the near-duplicate stage and stay
or go together. Empty tables pass through empty. Columns beyond those of
``documents`` are carried; one named ids, n_ids or decoded comes out of the last
stage as doc_ids, doc_n_ids or doc_decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobacct.llm import decontamination, near_dup, quality_rules, secrets, sentencepiece_fst
from jobacct.llm.common import stage, table
from jobacct.llm.queries import SENTENCEPIECE_MODEL


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: documents that the rules reject go."""
    return quality_rules.filter_documents(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: one document of each group stays (five-word shingles, similarity 0.8)."""
    return near_dup.filter_documents(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """2: benchmark passages leave the texts; a document that is mostly such goes."""
    return decontamination.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: secrets are replaced by their kind."""
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """5: token ids and the text decoded from them."""
    model = sentencepiece_fst.read_model(spark, SENTENCEPIECE_MODEL)
    made = set(sentencepiece_fst.SCHEMA.names)
    held = docs.withColumnsRenamed({c: f"doc_{c}" for c in docs.columns if c.lower() in made})
    return sentencepiece_fst.encode_decode(held, model, keep=[c for c in held.columns if c != "text"])


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("SentencePiece", encode),
]
#: Similarity components, decoded layers and token paths are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(spark, f(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
