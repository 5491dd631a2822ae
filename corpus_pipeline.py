"""A corpus pipeline: quality, exact and near duplicates, mixing, tokens.

Each stage takes the documents that the one before it kept and is written as Parquet
before the next one reads it, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, exact_dedup, jaccard, mixing, quality
from quillmesh.llm.common import materialise, table
from quillmesh.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of these documents."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays.

    Near duplicates share at least 0.8 of their five-word shingles, counted exactly.
    """
    return jaccard.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeated document has several rows."""
    return mixing.sample(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, and whether decoding gives the text back."""
    path = tokenizer_path()
    found = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), path), path)
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The classifier is fitted and shingles use a hash that SQL lacks, so there is no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
