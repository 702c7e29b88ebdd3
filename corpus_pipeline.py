"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.  Rows
that repeat stay repeated up to the near-duplicate stage, which keeps one.
Null texts have no language and go at the first stage; a null id is no one's first
copy; tables without rows give none; other columns than those of ``documents``
are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, linededup, packing, simhash, toxicity
from tessella.llm.common import DOC_COLUMNS, held_out, save
from tessella.llm.similar import SimilarParams
from tessella.plans.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; the others go."""
    ship(spark)
    dicts = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs, dicts, keep=DOC_COLUMNS).where("not rejected").select(*DOC_COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by a model of the labelled ones among them."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=DOC_COLUMNS).where("predicted = 0").select(*DOC_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines."""
    out = linededup.dedup_lines(docs, keep=DOC_COLUMNS)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*DOC_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: links of op5, and of texts with 0.8 of their five-word shingles in common."""
    ship(spark)
    return simhash.representatives(docs.select(*DOC_COLUMNS), similar=SimilarParams())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document, placed in sequences."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", packing_stage),
]

#: The language, toxicity and packing stages cannot be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
