"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next.
Counted as part of the llm subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterflow.llm import decontaminate, jaccard_join, quality_rules, secrets, sentencepiece_codec
from rasterflow.llm.common import materialize, read
from rasterflow.llm.queries import BYTE_BPE, PATTERN, PIECES


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; elsewhere runs of more than 50 benchmark words are cut out."""
    return decontaminate.remove_spans(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to [kind]; all documents stay."""
    return secrets.redact(docs, BYTE_BPE, PATTERN)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, with their number and checksum."""
    return sentencepiece_codec.encode_documents(docs, PIECES, keep_ids=True)


STAGES = [
    ("quality_rules", apply_rules),
    ("jaccard_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: The secret scan's token test and the ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next reads it.

    Null and empty texts go with the quality rules; of rows that are equal one stays; rows of one doc_id with unlike texts are
    documents of their own; an empty table gives an empty result; further columns come along up to the last stage.
    """
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
