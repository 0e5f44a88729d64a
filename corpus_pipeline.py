"""The training-data pipeline: five stages, each an operator of tagwright.llm, written and reread in turn.

    quality rules -> MinHash near-dedup -> benchmark decontamination -> secret scan -> best-fit packing

Every stage works on all that its predecessor kept. The first three drop
documents, the fourth masks what it found in the texts, and the last returns
the packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

Defined cases, the same in every stage: NULL and empty texts fail the quality rules; of repeated rows one stays, of
different texts under one doc_id each is a document of its own; rows without a doc_id are judged by their text, and near-dedup leaves them as they are;
very long texts are worked on whole; of equally good rows the one with the least doc_id stays; an empty table gives an
empty one; columns beyond those of documents are passed through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwright.llm import decontaminate, minhash_dedup, packing, quality_rules, secret_scan
from tagwright.llm.common import materialize, slim_batches, table


def quality(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents that the default policy of the rule ledger keeps; the columns of documents."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return quality_rules.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id."""
    slim_batches(spark)
    return minhash_dedup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in the text."""
    slim_batches(spark)
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    slim_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: Sampling, checksums and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
