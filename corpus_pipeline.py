"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding. Part of the llm subpackage.

Stages carry all columns of their input, whatever they are called, and each defines what becomes of rows without a text or
an id; very long texts are read whole everywhere. A stage's own tables are deleted once its result is written.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, jaccard_join, langid, mixing, pieces
from factloom.llm.common import discard, materialize, packed, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go; the others stay. Repeated rows stay repeated;
    of an empty table, or one without any label, nothing stays."""
    return langid.accepted(docs, *langid.fit_documents(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, once; documents without an id count as copies of those with one."""
    found = exact_dedup.exact_dedup(docs).filter("NOT kept AND keep_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    text = F.translate(F.coalesce(F.col("row.text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    keyed = packed(docs, doc_id=F.col("row.doc_id").cast("long"), text_sha256=F.sha2(text.cast("binary"), 256))
    left = keyed.join(found, keyed["doc_id"].eqNullSafe(found["id"]) & (keyed["text_sha256"] == found["sha"]), "left_anti")
    return left.dropDuplicates(["doc_id", "text_sha256"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (words in shingles of five, similarity 0.8) the smallest doc_id stays; documents
    without an id are compared with none and stay."""
    gone = jaccard_join.jaccard_components(docs, k=5, percent=80).filter("doc_id <> component_id").select(F.col("doc_id").alias("id"))
    rows = packed(docs, doc_id=F.col("row.doc_id"))
    return rows.join(gone, rows["doc_id"] == gone["id"], "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities raked to the source, language and topic marginals. Repeated rows share a
    decision; an empty table stays empty."""
    return mixing.mixed_sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and digests of each row that is left, repeated or not; an empty table gives none."""
    return pieces.encoded(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mixed), ("sentencepiece", encode)]
#: The stages' models and iterations have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch() as keep:  # what the stage wrote for itself goes, and its input if a stage wrote it
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
