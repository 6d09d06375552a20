"""Queries that fit a model. They have no SQL form; tests check them on planted data."""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.functions.text import default_stopwords
from lexigrow.operators.classifiers import (
    NAMES,
    add_score,
    candidate,
    run_classifiers,
    score_all,
    training_rows,
)
from lexigrow.operators.density import density_clusters
from lexigrow.operators.lasso import lasso_keywords
from lexigrow.operators.metrics import confusion_metrics
from lexigrow.operators.neighbors import fit_word_vectors, word_vectors
from lexigrow.operators.sampling import stratified_split
from lexigrow.operators.tfidf import feature_names, vectorize
from lexigrow.plans import cosine, king, linder
from lexigrow.plans.features import add_terms, train_and_validation
from lexigrow.session import settled
from suite.relational import MIN_DF, SEED, tfidf_keywords_top10
from suite.tables import labelled_tokens, table, tokenised

FEATURES = {"min_df": MIN_DF, "max_df": 0.25, "max_features": 100}
LASSO = {"min_df": MIN_DF, "max_features": 50}
ITERATIONS = 10
FOLDS = 2
MIN_CLUSTER, MIN_SAMPLES = 20, 5


def _sets(spark: SparkSession, folder: str):
    """Training and validation parts of the labelled documents."""
    docs = settled(labelled_tokens(spark, folder).select("doc_id", "toxic", "tokens"))
    split = settled(stratified_split(docs, "toxic", "doc_id", 0.2, SEED))
    return split.where("split = 'train'"), split.where("split = 'test'")


def _features(spark, folder):
    train, check = _sets(spark, folder)
    return train_and_validation(train, check, "doc_id", "toxic", "tokens", seed=SEED, **FEATURES)


def _prepared(spark, folder):
    train, check, vectorizer = _features(spark, folder)
    rows = training_rows(train.drop("tokens"), "toxic", "doc_id", FOLDS, seed=SEED)
    held_out = settled(check.select("doc_id", F.col("toxic").cast("double").alias("label"), "features"))
    return rows, held_out, vectorizer


def _all_documents(spark, folder, vectorizer) -> DataFrame:
    docs = tokenised(spark, folder).select("doc_id", "tokens")
    return vectorize(vectorizer, add_terms(docs, "tokens")).select("doc_id", "features")


def train_features(spark, folder):
    train, check, _ = _features(spark, folder)
    rows = train.withColumn("split", F.lit("train")).unionByName(
        check.withColumn("split", F.lit("validation"))
    )
    values = vector_to_array("features")
    return rows.select(
        "doc_id",
        "toxic",
        "split",
        F.size(F.filter(values, lambda x: x > 0)).alias("n_terms"),
        F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 6).alias("weight_sum"),
    )


def classifier_scores(name: str, spark, folder):
    """One model, fitted on the training part, on every document."""
    rows, _, vectorizer = _prepared(spark, folder)
    cand = candidate(
        name, len(feature_names(vectorizer)), rows.count(), full=False, iterations=ITERATIONS, seed=SEED
    )
    model = cand.estimator.fit(rows, cand.grid[0])
    column = f"y_pred_prob_{name}"
    scored = add_score(model, _all_documents(spark, folder, vectorizer), name)
    return scored.select("doc_id", F.round(column, 6).alias(column))


def _trained(spark, folder, names=NAMES, full=False):
    rows, held_out, vectorizer = _prepared(spark, folder)
    models, results = run_classifiers(
        rows, held_out, len(feature_names(vectorizer)), names, full, ITERATIONS, FOLDS, seed=SEED
    )
    return models, results, vectorizer


def _flat(results: DataFrame) -> DataFrame:
    metrics = ("f1", "precision", "recall", "roc_auc", "accuracy")
    return results.select(
        "clf_name",
        "train_score",
        *[F.col("test_scores")[m].alias(m) for m in metrics],
        F.to_json("params").alias("params"),
    )


def grid_search_results(spark, folder):
    return _flat(_trained(spark, folder, ("LogisticRegression",), full=True)[1])


def clf_results(spark, folder):
    return _flat(_trained(spark, folder)[1])


def ensemble_scores(spark, folder):
    models, _, vectorizer = _trained(spark, folder)
    return score_all(models, _all_documents(spark, folder, vectorizer)).drop("features")


def predicted_docs(spark, folder):
    train, check = _sets(spark, folder)
    docs = tokenised(spark, folder).select("doc_id", "tokens")
    scored = linder.predicted_documents(
        train, check, docs, "doc_id", "toxic", "tokens", full_grid=False, iterations=ITERATIONS,
        folds=FOLDS, features=FEATURES, seed=SEED,
    )
    return scored.drop("tokens")


def density(spark, folder):
    """Clusters of two-number score vectors."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id",
        *[F.round(F.col("embedding")[i].cast("double"), 3).alias(f"y_pred_prob_{i}") for i in (0, 1)],
    )
    return density_clusters(
        vectors, ["y_pred_prob_0", "y_pred_prob_1"], "vec_id", MIN_CLUSTER, MIN_SAMPLES, seed=SEED
    ).select("vec_id", "cluster")


def lasso(spark, folder):
    docs = labelled_tokens(spark, folder).withColumnRenamed("toxic", "y")
    return lasso_keywords(docs, "doc_id", "tokens", stopwords=default_stopwords(), seed=SEED, **LASSO)


def word_vector_table(spark, folder):
    docs = tokenised(spark, folder)
    vectors = word_vectors(fit_word_vectors(docs, "tokens", size=50, min_count=50, seed=SEED))
    return vectors.select("word", F.array_join(F.transform("vector", lambda x: F.round(x, 6)), " ").alias("vector"))


def embedding_classifier(spark, folder):
    docs = labelled_tokens(spark, folder).select("doc_id", "toxic", "tokens")
    _, held_out = linder.embedding_classifier(docs, "doc_id", "toxic", "tokens", size=50, seed=SEED)
    return confusion_metrics(held_out, "label", "prediction")


def king_keywords(spark, folder):
    train, check = _sets(spark, folder)
    docs = tokenised(spark, folder).select("doc_id", "tokens")
    found = king.king_keywords(
        train, check, docs, "doc_id", "toxic", "tokens", n_frequent=100, full_grid=False,
        iterations=ITERATIONS, folds=FOLDS, min_cluster_size=MIN_CLUSTER, min_samples=MIN_SAMPLES,
        features=FEATURES, seed=SEED,
    )
    return found.keywords.select(
        "keywords", F.array_join("clusters", ",").alias("clusters"), "support"
    )


def linder_keywords(spark, folder):
    train, check = _sets(spark, folder)
    docs = tokenised(spark, folder).select("doc_id", "tokens")
    return linder.linder_keywords(
        train, check, docs, "doc_id", "toxic", "tokens", lasso=LASSO, full_grid=False,
        iterations=ITERATIONS, folds=FOLDS, features=FEATURES, seed=SEED,
    )


def linder_embedding_keywords(spark, folder):
    docs = labelled_tokens(spark, folder).select("doc_id", "toxic", "tokens")
    corpus = tokenised(spark, folder).select("doc_id", "tokens")
    return linder.linder_embedding_keywords(
        docs, corpus, "doc_id", "toxic", "tokens", lasso=LASSO, model={"size": 50}, seed=SEED
    )


def cosine_keywords(spark, folder):
    seeds = tfidf_keywords_top10(spark, folder).select(F.col("keyword").alias("word"))
    corpus = tokenised(spark, folder)
    return cosine.cosine_keywords(corpus, seeds, size=50, min_count=20, seed=SEED)


QUERIES = {
    "train_features": train_features,
    "clf_random_forest": partial(classifier_scores, "RandomForest"),
    "clf_naive_bayes": partial(classifier_scores, "NaiveBayes"),
    "clf_linear_svc": partial(classifier_scores, "SVC"),
    "clf_mlp": partial(classifier_scores, "MLP"),
    "clf_logistic": partial(classifier_scores, "LogisticRegression"),
    "clf_decision_tree": partial(classifier_scores, "DecisionTree"),
    "clf_sgd": partial(classifier_scores, "SGD"),
    "grid_search_results": grid_search_results,
    "clf_results": clf_results,
    "ensemble_scores": ensemble_scores,
    "predicted_docs": predicted_docs,
    "density_clusters": density,
    "lasso_keywords": lasso,
    "word_vectors": word_vector_table,
    "embedding_classifier": embedding_classifier,
    "king_keywords": king_keywords,
    "linder_keywords": linder_keywords,
    "linder_embedding_keywords": linder_embedding_keywords,
    "cosine_keywords": cosine_keywords,
}
