"""Tables, and documents seen as articles of a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """id, title, content, source_id, priority, published (one an hour from 2024-01-01), ord."""
    docs = read(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        T.first_line(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("source_id"),
        (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 4 + 1).alias("priority"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id as int), 0, 0)").alias("published"),
        F.col("doc_id").alias("ord"),
    )


def source_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The enabled sources of a JSON catalog {sources: [...]}, one row each."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("sources").alias("s")).select("s.*")
    return rows.where("enabled")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
