"""Training-data pipeline over `documents`: toxicity, quality rules, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of documents; the last returns packed
pieces. Columns beyond those of documents go along, whatever their names. An
empty table gives empty tables.

Toxicity and quality rules judge each row by itself: a null or empty text is not
toxic, and fails the quality rules. Near-dedup names documents by doc_id: rows
that repeat one are one document, of which one row stays; rows with a null doc_id
can't be named, so all of them stay. Packing takes every row as a document; a null
text is an end id alone. Texts of any length go through whole.

It belongs to the optional subpackage `tessera.llm` and goes with it; nothing
else imports it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kneser_ney, near_dedup, packing, toxicity
from tessera.llm.common import drop_path, scratch_path, small_batches, stage

TOXIC = 0.7

#: SQL can't express the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _learned_from() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of TOXIC or more."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_learned_from())
    model = toxicity.train(docs.where(_learned_from()), labels)
    return toxicity.reject(docs, model, TOXIC)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie outside their language's perplexity bands."""
    small_batches(spark)
    return kneser_ney.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8)."""
    small_batches(spark)
    found = near_dedup.near_duplicates(docs)
    kept = _named(docs, found.where("kept"))
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; a row is a piece with its ids and place."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.where("doc_id is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        docs = stage(function(spark, docs, sf_dir), name, path)
        if before:  # all that was read from it has been written
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
