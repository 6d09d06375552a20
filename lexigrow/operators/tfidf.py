"""TF-IDF weights, in two forms.

* Long form: one row per (document, term). No limit on the vocabulary; shuffles by document.
* Vector form: for a capped vocabulary. A fitted ``PipelineModel`` of JVM transformers maps
  each row on its own, so scoring a corpus needs no shuffle at all.

The weight is ``tf * (ln((1 + N) / (1 + df)) + 1)``, divided by the document's L2 norm.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.functions.text import unnest
from lexigrow.operators.vocabulary import build_vocabulary, ngram_vocabulary


def idf(df_col: Column, n_docs: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def weigh(
    df: DataFrame, vocabulary: DataFrame, n_docs: int, key: str, terms: str = "terms"
) -> DataFrame:
    """Apply a fitted vocabulary ``(term, df)`` to documents: ``(key, term, tf, w)``.

    Documents without any known term give no rows.
    """
    counts = (
        unnest(df, F.col(terms), "term", keep=[key])
        .join(vocabulary.select("term", "df"), "term")
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("df").alias("df"))
    )
    raw = counts.withColumn("raw", F.col("tf") * idf(F.col("df"), F.lit(n_docs)))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", (F.col("raw") / norm).alias("w"))


def fit_weigh(
    df: DataFrame,
    key: str,
    terms: str = "terms",
    min_df: float = 25,
    max_df: float = 0.2,
    max_features: int | None = None,
) -> DataFrame:
    """Fit a vocabulary on ``df`` and weigh the same documents, in long form."""
    vocabulary = build_vocabulary(df, terms, min_df, max_df, max_features)
    return weigh(df, vocabulary, df.count(), key, terms)


def fit_vectorizer(
    df: DataFrame,
    terms: str = "terms",
    output: str = "features",
    min_df: float = 25,
    max_df: float = 0.2,
    max_features: int = 2000,
    words: str | None = None,
) -> PipelineModel | None:
    """Fit the vector form; ``None`` when pruning leaves no term.

    ``max_features`` bounds what reaches the driver. The feature index follows the terms'
    alphabetical order. If ``terms`` are the words and bigrams of a column, ``words`` names it.
    """
    n_docs = df.count()
    if words is None:
        rows = build_vocabulary(df, terms, min_df, max_df, max_features).collect()
    else:
        rows = ngram_vocabulary(df, words, min_df, max_df, max_features).collect()
    if not rows:
        return None
    rows.sort(key=lambda row: row["term"])
    weights = [math.log((1.0 + n_docs) / (1.0 + row["df"])) + 1.0 for row in rows]
    counter = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in rows], inputCol=terms, outputCol=f"{output}_tf"
    )
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense(weights), inputCol=f"{output}_tf", outputCol=f"{output}_raw"
    )
    normalizer = Normalizer(p=2.0, inputCol=f"{output}_raw", outputCol=output)
    return PipelineModel([counter, scaler, normalizer])


def vectorize(model: PipelineModel, df: DataFrame, output: str = "features") -> DataFrame:
    return model.transform(df).drop(f"{output}_tf", f"{output}_raw")


def feature_names(model: PipelineModel) -> list[str]:
    """Term of each feature index."""
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    return list(counter.vocabulary)


def top_terms_of_vector(features: str, names: list[str], n: int = 10) -> Column:
    """The n heaviest terms of one vector as ``array<struct<weight, term>>``.

    Ordered by weight, then feature index, both descending; weights rounded half-even to
    three places after ordering. Works inside the row, so no shuffle.
    """
    weighted = F.transform(
        vector_to_array(F.col(features)),
        lambda w, i: F.struct(w.alias("weight"), i.alias("index")),
    )
    present = F.filter(weighted, lambda s: s["weight"] > 0)
    best = F.slice(F.sort_array(present, asc=False), 1, n)
    vocabulary = F.array(*[F.lit(name) for name in names])
    return F.transform(
        best,
        lambda s: F.struct(
            F.get(vocabulary, s["index"]).alias("term"),
            F.bround(s["weight"], 3).alias("weight"),
        ),
    )


def top_terms_long(weights: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n heaviest terms per document of a long weight table."""
    order = Window.partitionBy(key).orderBy(F.desc("w"), F.desc("term"))
    return (
        weights.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(key, "term", "rank", F.bround("w", 3).alias("weight"))
    )
