"""The test tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.functions.text import word_tokens
from lexigrow.sources.tables import spread_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, lang, text`` with the text lowered."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return docs.withColumn("text", F.lower("text"))


def tokenised(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, lang, tokens``."""
    return documents(spark, folder).select(
        "doc_id", "lang", word_tokens(F.col("text")).alias("tokens")
    )


def spread_tokens(docs: DataFrame) -> DataFrame:
    """Documents with ``tokens`` in place of ``text``, in tasks small enough to count terms in."""
    return spread_text(docs).withColumn("text", word_tokens(F.col("text"))).withColumnRenamed(
        "text", "tokens"
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label: ``doc_id, lang, text, quality, toxic``."""
    return documents(spark, folder).join(table(spark, folder, "labels"), "doc_id")


def labelled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, quality, toxic, tokens``."""
    return labelled(spark, folder).select(
        "doc_id", "quality", "toxic", word_tokens(F.col("text")).alias("tokens")
    )


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Tokenised documents with their language as the cluster."""
    return tokenised(spark, folder).withColumnRenamed("lang", "cluster")
