"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows
as Parquet in the shared checkpoint folder, rereads them for the next, and then deletes those
before. All stages but the last
return the columns of ``documents``, whatever they are.

Defined results: null and empty texts go through every stage as the operators define; stages on
an empty table return an empty table; extra columns are kept; repeated rows are kept but where a
stage keeps one document of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm import bpe, line_dedup, mixing, near_copies, quality
from vantloom.runtime import discard, passing_checkpoints, scratch, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field accepts; it learns from the labelled ones outside the held-out fold."""
    field = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.drop_rejected(docs, field)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; a document left with no text goes."""
    done = line_dedup.dedup_lines(docs)
    deleted = F.col(done.columns[-1])
    recount = F.when(deleted > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")) if {"text", "n_chars"} <= set(docs.columns) else None
    columns = [recount.alias(c) if c == "n_chars" and recount is not None else F.col(c) for c in docs.columns]
    return done.filter((deleted == 0) | (F.col("text") != "")).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts similar by 0.8 or more in five-word shingles."""
    return near_copies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; one that two epochs take stands twice."""
    return mixing.mix_documents(docs).select(*docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return bpe.bpe_digests(docs, *bpe.production_ranks())


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", remove_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_bytes),
]

#: A trained field and SimHash components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with passing_checkpoints(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            discard(spark, f"{folder}/{number - 1}")
    return docs
