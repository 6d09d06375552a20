"""A pipeline from raw documents to token numbers, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. Rows without an id pass the two deduplication stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.llm import bpe, lsh_forest, mixing, recompress, toxicity
from lexigrow.llm.store import kept, measured

#: From this score on a document is rejected as toxic.
TOXIC = 0.7
#: Words of the windows whose later copies are removed.
WINDOW = 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labels that are
    not held out (crc32 of the id modulo 3 is not 1); without labels all documents stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.fit(toxicity.labelled_texts(docs, labels))
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group linked on five-word shingles."""
    found = lsh_forest.near_duplicates(docs)
    others = found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(measured(others), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that occur earlier; ``n_chars`` follows the text.
    Documents that lose nothing keep their text as it is, null as empty."""
    others = [c for c in docs.columns if c != "text"]
    found = recompress.without_repeats(docs, window=WINDOW, carry=others, as_it_was=True)
    columns = {c: F.col(f"row.`{c}`") for c in others}
    columns["text"] = F.col("kept_text")
    columns["n_chars"] = F.length("kept_text").cast("long")
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of every document as digests, with the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(docs, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: The classifier and the sampling cannot be written in SQL; tests hold the stages against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, "stage")
    return docs
