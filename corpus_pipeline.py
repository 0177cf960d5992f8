"""A training corpus from `documents`: quality filter, line dedup, near-dedup, packing. Each stage calls one operator."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free, save, table
from tidemark.llm.lines import WHOLE, dedup_lines
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Rows travel as one struct, so their columns cannot clash."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    judged = classify(rows, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"), keep=["row"])
    return judged.where("accepted").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each component of near-equal lines; a document whose lines all stand elsewhere goes."""
    return dedup_lines(docs, **WHOLE).withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    (gone,) = free(docs.columns, "gone")
    dropped = near_duplicates(docs, k=5).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("packing", packing)]

#: A learned classifier and MinHash components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
