"""Corpus pipeline: quality filter, near-duplicates, benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A runner may write each stage's result and give the next one the table read back.

Defined results, for every stage: a null text counts as an empty one and stays null; a null id is a document of
its own; rows that repeat are judged alike; an empty table gives an empty one; columns besides those of ``documents``
pass through whatever their names, but for the last stage, which returns the pieces' columns. Texts of any length are
read whole. What only one stage decides is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoloom.llm import decontaminate, packing, quality, secrets, similar
from sonoloom.plans.scratch import materialise


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned here from ``labels``, rejects go.

    Empty texts get the intercept's score; a score equal to the threshold stays; without labels all stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that five-word shingle similarity of 0.8 or more connects stays.

    Candidates come from the covering SimHash. Of a group the smallest id stays, a null id only where no other is; of rows
    that repeat that id, the text with the smallest hash, once. All texts without words are one group.
    """
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; without items, and without words, all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark, overlapping ones a single mark; n_chars follows the text and is null where it is null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, placed in sequences of 1024 tokens; an empty text is its end token."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", sequence_packing),
]
#: SQL can express neither the learned model, nor fingerprints of hashed words, nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``; each result is written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
