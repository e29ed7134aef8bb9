"""The driver's tables, and how they stand in for a library's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (the whole first line), category, lang, text, n_chars of each document."""
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), F.col("source").alias("category"), "lang", "text", "n_chars")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, paper_id, vec."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("paper_id"), F.col("embedding").alias("vec"))
