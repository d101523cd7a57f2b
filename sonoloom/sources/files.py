"""Readers and writers of the file forms: annotation JSON, label CSV, key and metric tables; see also ``headers`` and ``arrays``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

def read_texts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, json): whole files of a tree; hidden resource forks are left out."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")).where(~F.substring_index("path", "/", -1).startswith("._"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(category, label) of a CSV file without a head line, both trimmed."""
    return spark.read.schema("category string, label string").csv(path).select(F.trim("category").alias("category"), F.trim("label").alias("label"))


def write_table(df: DataFrame, path: str) -> None:
    """A CSV table with its column names: keys, metrics."""
    df.write.option("header", "true").csv(path)


def write_documents(docs: DataFrame, path: str, by: str = "rater") -> None:
    """JSON documents, one a line, in a folder for each ``by``."""
    docs.select(by, "json").write.partitionBy(by).text(path)


def append_measurements(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
