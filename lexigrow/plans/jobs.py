"""The flows from files to files.

A flow has a folder ``<base_dir>/<flow>``. Its ``dat`` holds the labelled sets as gzip TSV with
``id_str``, ``joined_text`` and ``is_protest``; models go to ``clfs`` and labelled rows to
``labeled`` beside it. Documents to score are TSV with ``id_str`` and ``joined_text``. What a
run leaves there is reused by the next. ``stopwords`` is a file with one word per line or the
words themselves; results are written as TSV to ``out`` if that is given.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.plans.cosine import cosine_keywords
from lexigrow.plans.king import KingResult, king_keywords
from lexigrow.plans.linder import linder_embedding_keywords, linder_keywords
from lexigrow.plans.tfidf_keywords import tfidf_keywords
from lexigrow.sources.tables import (
    read_corpus,
    read_documents,
    read_labelled,
    read_seed_keywords,
    read_stopwords,
    write_tsv,
)

KEY, TOKENS, LABEL = "id_str", "joined_text", "is_protest"


def _words(spark: SparkSession, stopwords: str | Iterable[str] | None) -> list[str] | None:
    if stopwords is None:
        return None
    return read_stopwords(spark, stopwords) if isinstance(stopwords, str) else list(stopwords)


def _written(df: DataFrame, out: str | None) -> DataFrame:
    if out is not None:
        write_tsv(df, out)
    return df


def tfidf_job(
    spark: SparkSession,
    base_dir: str,
    flow: str = "tfidf",
    out: str | None = None,
    stopwords: str | Iterable[str] | None = None,
    **options,
) -> DataFrame:
    """Keywords of the positive rows of the full labelled set."""
    docs = read_labelled(spark, base_dir, flow, "full", split=False)
    positive = docs.where(F.col(LABEL) == 1)
    words = tfidf_keywords(positive, TOKENS, stopwords=_words(spark, stopwords), **options)
    return _written(words, out)


def king_job(
    spark: SparkSession,
    base_dir: str,
    documents: str,
    flow: str = "king",
    word_frequencies: str | None = None,
    stopwords: str | Iterable[str] | None = None,
    out: str | None = None,
    **options,
) -> KingResult:
    """The clustering flow. ``word_frequencies`` is a parquet table with a column ``word``;
    without it the corpus's own frequent words are left out. Keywords and summary go to
    ``<out>/keywords`` and ``<out>/summary``."""
    frequent = None if word_frequencies is None else spark.read.parquet(word_frequencies)
    result = king_keywords(
        read_labelled(spark, base_dir, flow, "train"),
        read_labelled(spark, base_dir, flow, "validation"),
        read_documents(spark, documents),
        KEY,
        LABEL,
        TOKENS,
        frequent=frequent,
        folder=f"{base_dir}/{flow}",
        stopwords=_words(spark, stopwords),
        **options,
    )
    if out is not None:
        write_tsv(result.keywords, f"{out}/keywords")
        write_tsv(result.summary, f"{out}/summary")
    return result


def linder_job(
    spark: SparkSession,
    base_dir: str,
    documents: str,
    flow: str = "linder",
    stopwords: str | Iterable[str] | None = None,
    out: str | None = None,
    **options,
) -> DataFrame:
    """The lasso flow."""
    found = linder_keywords(
        read_labelled(spark, base_dir, flow, "train"),
        read_labelled(spark, base_dir, flow, "validation"),
        read_documents(spark, documents),
        KEY,
        LABEL,
        TOKENS,
        folder=f"{base_dir}/{flow}",
        stopwords=_words(spark, stopwords),
        **options,
    )
    return _written(found, out)


def linder_embedding_job(
    spark: SparkSession,
    base_dir: str,
    documents: str,
    flow: str = "bert",
    model_name: str = "model",
    model: dict | None = None,
    stopwords: str | Iterable[str] | None = None,
    out: str | None = None,
    **options,
) -> DataFrame:
    """The lasso flow with word vectors; texts are lowered before they are scored."""

    def lowered(df: DataFrame) -> DataFrame:
        words = F.split(F.lower("text"), r"\s+") if "text" in df.columns else F.col(TOKENS)
        return df.withColumn(TOKENS, words)

    found = linder_embedding_keywords(
        lowered(read_labelled(spark, base_dir, flow, "train", split=False, with_text=True)),
        lowered(read_documents(spark, documents, split=False, with_text=True)),
        KEY,
        LABEL,
        TOKENS,
        model={"path": f"{base_dir}/{flow}/{model_name}", **(model or {})},
        stopwords=_words(spark, stopwords),
        **options,
    )
    return _written(found, out)


def cosine_job(
    spark: SparkSession,
    text: str,
    seeds: str | Iterable[str],
    model: str | None = None,
    out: str | None = None,
    **options,
) -> DataFrame:
    """Neighbours of the seed words in the space of a plain text corpus. ``seeds`` is a file of
    seed keywords or the words themselves."""
    if isinstance(seeds, str):
        table = read_seed_keywords(spark, seeds).select(F.col("hashtags").alias("word"))
    else:
        table = spark.createDataFrame([(word,) for word in seeds], "word string")
    return _written(cosine_keywords(read_corpus(spark, text), table, path=model, **options), out)
