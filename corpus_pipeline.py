"""From raw documents to packed training sequences.

Language ID drops what it rejects, near-duplicate detection keeps one document of each group, secrets
are redacted in place, sources are mixed to their targets, and the mix is packed into sequences. Each
stage takes the documents that its predecessor kept, as a table that was written and read again, and
all but the last return the columns of documents. No SQL engine can express the language model, the
pieces of the tokenizer or the packing, so there is no SQL for the result; tests hold each stage
against a plain version of what it decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm import common, language, mixing, neardup, packing, secrets

Docs = DataFrame


def identified(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents whose language is known; those too far from every centroid, and those without a letter, go."""
    return language.identify(docs, prefix="__").where(~F.col("__rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicated(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """The document with the smallest id of each group of near-duplicates: five words, similarity 0.8.

    Rows that repeat an id are one document, of which the first text in order stays. Rows without an id
    are told apart by their words and come after all others.
    """
    return neardup.keep_one(docs, shingle=5, percent=80, distance=21)


def redacted(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """All documents, with each secret in their texts replaced by a mark."""
    return secrets.redact(docs, chars_col="n_chars")


def mixed(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """A row for each time the mix takes a document; one document per source is cut where its target ends."""
    return mixing.mixed_documents(docs, chars_col="n_chars")


def packed(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """A row per piece with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [("language_id", identified), ("near_dedup", deduplicated), ("secret_scan", redacted), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    Once a stage is written, what it checkpointed and the table that it read are deleted. The table that
    the last stage reads stays until the session's checkpoint folder goes.
    """
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    source: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        before = set(common.written())
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            common.forget(spark, [*source, *(f for f in common.written() if f not in before)])
            source = [f"{folder}/{name}"]
    return docs
