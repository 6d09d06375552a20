"""Queries on text, vocabularies, samples, scores, itemsets and neighbours.

Every one has an equivalent in :mod:`suite.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.functions.numeric import sigmoid, softmax_positive
from lexigrow.functions.text import (
    default_stopwords,
    drop_stopwords,
    glued,
    parse_tokens,
    unnest,
    with_terms,
    word_tokens,
)
from lexigrow.operators import itemsets as its
from lexigrow.operators import sampling, scoring, tfidf, vocabulary
from lexigrow.operators.batch_scoring import batch_scores, linear_model_loader
from lexigrow.operators.classifiers import NAMES
from lexigrow.operators.lasso import feature_moments, lasso_matrix
from lexigrow.operators.metrics import confusion_metrics, roc_auc
from lexigrow.operators.neighbors import expand_seeds, nearest
from lexigrow.plans.tfidf_keywords import document_top_terms, tfidf_keywords
from suite.tables import (
    clusters,
    documents,
    labelled,
    labelled_tokens,
    spread_tokens,
    table,
    tokenised,
)

MIN_DF = 5
MAX_DF = 0.25
CLUSTER_MIN_SIZE = 20
SEED = 7
FREQUENT = 100


def labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled(spark, folder)
    return docs.select(
        "doc_id", "quality", "toxic", F.size(word_tokens(F.col("text"))).alias("n_tokens")
    )


def positive_docs(spark, folder):
    return labelled_docs(spark, folder).where("quality = 1").select("doc_id", "n_tokens")


def lower_text(spark, folder):
    docs = documents(spark, folder)
    return docs.select("doc_id", F.md5("text").alias("text_md5"))


def tokens_space(spark, folder):
    raw = table(spark, folder, "documents").select("doc_id", "text")
    tokens = raw.select("doc_id", parse_tokens(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


def tokens_mixed(spark, folder):
    """Every text as a quoted list of its words, and as prose after a bracket."""
    raw = table(spark, folder, "documents").select("doc_id", "text")
    words = F.array_join(word_tokens(F.col("text")), "', '")
    listed = raw.select(
        "doc_id", F.lit("list").alias("form"), F.concat(F.lit("['"), words, F.lit("']")).alias("t")
    )
    prose = raw.select(
        "doc_id",
        F.lit("prose").alias("form"),
        F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "text").alias("t"),
    )
    tokens = listed.union(prose).select("doc_id", "form", parse_tokens(F.col("t")).alias("tokens"))
    return tokens.select(
        "doc_id",
        "form",
        F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


def tokens_words(spark, folder):
    return tokenised(spark, folder).select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


def stopword_filter(spark, folder):
    kept = drop_stopwords(tokenised(spark, folder), "tokens", default_stopwords())
    return kept.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


def _terms(spark, folder, label: str | None = "quality"):
    docs = labelled(spark, folder).select("doc_id", "quality", "toxic", "text")
    docs = docs.where(F.col(label) == 1) if label else docs
    return with_terms(spread_tokens(docs), "tokens", default_stopwords(), output="terms")


def ngram_counts(spark, folder):
    docs = spread_tokens(documents(spark, folder))
    terms = with_terms(docs, "tokens", default_stopwords(), output="terms")
    return vocabulary.term_stats(terms)


def vocab_stats(spark, folder):
    docs = _terms(spark, folder)
    return vocabulary.build_vocabulary(docs, min_df=MIN_DF, max_df=MAX_DF)


def vocab_topn(spark, folder):
    docs = _terms(spark, folder)
    return vocabulary.build_vocabulary(docs, min_df=MIN_DF, max_df=MAX_DF, max_features=300)


def cluster_vocab(spark, folder):
    docs = drop_stopwords(clusters(spark, folder), "tokens", default_stopwords())
    return vocabulary.group_vocabulary(docs, "cluster").select("cluster", "term", "df", "n_docs")


def freq_words(spark, folder):
    return vocabulary.frequent_words(tokenised(spark, folder), "tokens", FREQUENT)


def tfidf_weights(spark, folder):
    weights = tfidf.fit_weigh(_terms(spark, folder), "doc_id", min_df=MIN_DF, max_df=MAX_DF)
    return weights.select("doc_id", "term", "tf", F.round("w", 6).alias("w"))


def tfidf_apply(spark, folder):
    fitted = _terms(spark, folder)
    words = vocabulary.build_vocabulary(fitted, min_df=MIN_DF, max_df=MAX_DF, max_features=300)
    rest = with_terms(tokenised(spark, folder), "tokens", default_stopwords(), output="terms")
    weights = tfidf.weigh(rest, words, fitted.count(), "doc_id")
    return weights.select("doc_id", "term", "tf", F.round("w", 6).alias("w"))


def tfidf_top_terms(spark, folder):
    docs = labelled(spark, folder).where("quality = 1").select("doc_id", "text")
    top = document_top_terms(docs, min_df=MIN_DF)
    rows = top.select("doc_id", F.posexplode_outer("top_terms").alias("pos", "t"))
    return rows.where("t is not null").select(
        "doc_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("t.term").alias("term"),
        F.col("t.weight").alias("weight"),
    )


def tfidf_keyword_table(spark, folder):
    docs = labelled(spark, folder).where("quality = 1")
    return tfidf_keywords(docs, min_df=MIN_DF)


def tfidf_keywords_top10(spark, folder):
    docs = labelled(spark, folder).where("quality = 1")
    found = tfidf_keywords(docs, min_df=MIN_DF)
    return found.orderBy(F.desc("tfidf_weight"), "keyword").limit(10)


# -- samples, splits, chunks


def class_balance_sample(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return sampling.sample_per_class(rows, "quality", "doc_id", 40, seed=SEED)


def cap_sample(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.sample_rows(rows, "doc_id", 150, seed=SEED)


def matched_negatives(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "toxic")
    return sampling.match_negatives(rows, "toxic", "doc_id", seed=SEED)


def cluster_contrast(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.contrast_samples(rows, "lang", "doc_id", seed=SEED)


def stratified_split(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return sampling.stratified_split(rows, "quality", "doc_id", seed=SEED)


def stratified_folds(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return sampling.stratified_folds(rows, "quality", "doc_id", seed=SEED)


def chunk_by_total(spark, folder):
    return sampling.chunk_by_total(table(spark, folder, "documents").select("doc_id"), "doc_id", 7)


def chunk_by_size(spark, folder):
    return sampling.chunk_by_size(table(spark, folder, "documents").select("doc_id"), "doc_id", 64)


def class_weights(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "toxic")
    return sampling.class_weights(rows, "toxic")


# -- scores and metrics


def _scores(spark, folder):
    """One score column per classifier name, from the first numbers of each vector."""
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        "vec_id",
        (F.col("label") == 1).cast("int").alias("label"),
        *[
            sigmoid(8 * F.col("embedding")[i].cast("double")).alias(f"y_pred_prob_{name}")
            for i, name in enumerate(NAMES)
        ],
    )


def score_matrix(spark, folder):
    kept = scoring.cluster_inputs(_scores(spark, folder)).drop("label")
    return kept.select(
        "vec_id", *[F.round(c, 6).alias(c) for c in scoring.score_columns(kept)]
    )


def ensemble_any_positive(spark, folder):
    return scoring.any_positive(_scores(spark, folder), 0.8).select("vec_id")


def predicted_label(spark, folder):
    return _scores(spark, folder).select(
        "vec_id", scoring.label_from_score(F.col("y_pred_prob_SGD")).alias("y")
    )


def softmax_score(spark, folder):
    vectors = table(spark, folder, "embeddings")
    z0, z1 = (F.col("embedding")[i].cast("double") * 10 for i in (0, 1))
    return vectors.select("vec_id", F.round(softmax_positive(z0, z1), 6).alias("score"))


def clf_metrics(spark, folder):
    wide = _scores(spark, folder)
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("clf_name"),
                (F.col(f"y_pred_prob_{name}") >= 0.5).cast("int").alias("prediction"),
            )
            for name in NAMES
        ]
    )
    rows = unnest(wide, pairs, "s", keep=["label"]).select("label", "s.clf_name", "s.prediction")
    return confusion_metrics(rows, "label", "prediction", by="clf_name")


def clf_auc(spark, folder):
    vectors = table(spark, folder, "embeddings")
    rows = vectors.select(
        (F.col("label") == 1).cast("int").alias("label"),
        F.col("embedding")[0].cast("double").alias("score"),
    )
    return roc_auc(rows, "label", "score").select(F.round("auc", 6).alias("auc"))


def batch_score_table(spark, folder):
    """A nearest-centroid model: its two weight rows are class means of the whole table."""
    vectors = table(spark, folder, "embeddings")
    width = 64
    means = vectors.groupBy((F.col("label") == 1).cast("int").alias("y")).agg(
        *[F.avg(F.col("embedding")[i].cast("double")).alias(str(i)) for i in range(width)]
    )
    weights = {row["y"]: [row[str(i)] for i in range(width)] for row in means.collect()}
    loader = linear_model_loader([weights[0], weights[1]])
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    scored = batch_scores(rows, "x", width, loader, ["vec_id", "label"])
    return scored.select(
        "vec_id", "label", F.round("y_pred_prob_BERT", 6).alias("y_pred_prob_BERT")
    )


# -- clusters and itemsets


def cluster_counts(spark, folder):
    rows = table(spark, folder, "documents").withColumnRenamed("lang", "cluster")
    return scoring.column_counts(rows, "cluster")


def distinct_clusters(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.agg(F.countDistinct("lang").alias("n_clusters"))


def cluster_size_filter(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("cluster"))
    return its.large_clusters(rows, "cluster", "doc_id", CLUSTER_MIN_SIZE)


def _itemsets(spark, folder):
    rows = its.large_clusters(clusters(spark, folder), "cluster", "doc_id", CLUSTER_MIN_SIZE)
    return its.cluster_itemsets(
        rows, "cluster", "doc_id", "tokens", default_stopwords(), seed=SEED
    )


def _frequent(spark, folder):
    return vocabulary.frequent_words(tokenised(spark, folder), "tokens", FREQUENT)


def _best(spark, folder):
    top = its.top_itemsets(_itemsets(spark, folder), "cluster")
    return its.drop_frequent(top, _frequent(spark, folder))


def cluster_itemsets(spark, folder):
    found = _itemsets(spark, folder)
    return found.select("cluster", glued(F.col("items"), " ").alias("items"), "support")


def itemset_likelihood(spark, folder):
    found = _itemsets(spark, folder)
    return found.select(
        "cluster",
        glued(F.col("items"), " ").alias("items"),
        "c1",
        "n1",
        "c0",
        "n0",
        F.round("likelihood", 6).alias("likelihood"),
    )


def itemset_top10(spark, folder):
    top = its.top_itemsets(_itemsets(spark, folder), "cluster")
    return top.select(
        "cluster",
        "rank",
        glued(F.col("items"), " ").alias("items"),
        F.round("likelihood", 6).alias("likelihood"),
    )


def itemsets_not_frequent(spark, folder):
    return _best(spark, folder).select(
        "cluster", "rank", glued(F.col("items"), " ").alias("items")
    )


def cluster_keywords(spark, folder):
    merged = its.merge_itemsets(_best(spark, folder), "cluster")
    return merged.select(
        "keywords",
        F.array_join("clusters", ",").alias("clusters"),
        F.round("support", 6).alias("support"),
    )


def cluster_summary(spark, folder):
    summary = its.summarize_clusters(_best(spark, folder), "cluster")
    return summary.select("cluster", "size", F.array_join("keywords", ";").alias("keywords"))


def itemset_presence(spark, folder):
    """Presence of each cluster's ten commonest words, each paired with the next."""
    rows = clusters(spark, folder)
    sides = its.with_contrast(rows, "cluster", "doc_id", SEED)
    words = vocabulary.group_vocabulary(
        drop_stopwords(rows, "tokens", default_stopwords()), "cluster", max_features=10
    )
    ranked = words.selectExpr(
        "cluster", "term", "row_number() over (partition by cluster order by df desc, term) as r"
    )
    sets = ranked.selectExpr("cluster", "explode(array(r, r - 1)) as set_id", "term as item")
    found = its.itemset_presence(sides, "cluster", "doc_id", "tokens", sets.where("set_id > 0"))
    return found.select("cluster", "set_id", "is_cluster", "n_rows", "has_item")


def fpgrowth_itemsets(spark, folder):
    docs = drop_stopwords(tokenised(spark, folder), "tokens", default_stopwords())
    items = docs.select(F.array_distinct("tokens").alias("items"))
    found = its.frequent_itemsets(items, "items", min_support=0.1)
    return found.select(glued(F.col("items"), " ").alias("items"), "freq")


def fpgrowth_triples(spark, folder):
    """Sets of up to three words, from baskets that repeat words."""
    docs = drop_stopwords(tokenised(spark, folder), "tokens", default_stopwords())
    found = its.frequent_itemsets(docs.select("tokens"), "tokens", min_support=0.12, max_len=3)
    return found.select(glued(F.col("items"), " ").alias("items"), "freq")


# -- lasso and neighbours


def lasso_input(spark, folder):
    docs = labelled_tokens(spark, folder).withColumnRenamed("toxic", "y")
    rows, _ = lasso_matrix(
        docs, "doc_id", "tokens", stopwords=default_stopwords(), min_df=MIN_DF, seed=SEED
    )
    return rows.select("doc_id", "y", "fold")


def lasso_moments(spark, folder):
    docs = labelled_tokens(spark, folder).withColumnRenamed("toxic", "y")
    rows, _ = lasso_matrix(
        docs, "doc_id", "tokens", stopwords=default_stopwords(), min_df=MIN_DF, seed=SEED
    )
    found = feature_moments(rows, "features", "y", "fold")
    return found.select("fold", "a", "b", F.round("total", 6).alias("total"))


def _neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    seeds = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id")
    )
    return nearest(vectors, seeds, "vec_id", "embedding", 25)


def cosine_topk(spark, folder):
    return _neighbours(spark, folder).select(
        "seed", "vec_id", "rank", F.round("similarity", 6).alias("similarity")
    )


def cosine_expansion(spark, folder):
    return expand_seeds(_neighbours(spark, folder), "vec_id")


QUERIES = {
    "labelled_docs": labelled_docs,
    "positive_docs": positive_docs,
    "lower_text": lower_text,
    "tokens_space": tokens_space,
    "tokens_mixed": tokens_mixed,
    "tokens_words": tokens_words,
    "stopword_filter": stopword_filter,
    "ngram_counts": ngram_counts,
    "vocab_stats": vocab_stats,
    "vocab_topn": vocab_topn,
    "cluster_vocab": cluster_vocab,
    "freq_words": freq_words,
    "tfidf_weights": tfidf_weights,
    "tfidf_apply": tfidf_apply,
    "tfidf_top_terms": tfidf_top_terms,
    "tfidf_keywords": tfidf_keyword_table,
    "tfidf_keywords_top10": tfidf_keywords_top10,
    "class_balance_sample": class_balance_sample,
    "cap_sample": cap_sample,
    "matched_negatives": matched_negatives,
    "cluster_contrast": cluster_contrast,
    "stratified_split": stratified_split,
    "stratified_folds": stratified_folds,
    "chunk_by_total": chunk_by_total,
    "chunk_by_size": chunk_by_size,
    "class_weights": class_weights,
    "score_matrix": score_matrix,
    "ensemble_any_positive": ensemble_any_positive,
    "predicted_label": predicted_label,
    "softmax_score": softmax_score,
    "clf_metrics": clf_metrics,
    "clf_auc": clf_auc,
    "batch_scores": batch_score_table,
    "cluster_counts": cluster_counts,
    "distinct_clusters": distinct_clusters,
    "cluster_size_filter": cluster_size_filter,
    "cluster_itemsets": cluster_itemsets,
    "itemset_likelihood": itemset_likelihood,
    "itemset_top10": itemset_top10,
    "itemsets_not_frequent": itemsets_not_frequent,
    "cluster_keywords": cluster_keywords,
    "cluster_summary": cluster_summary,
    "itemset_presence": itemset_presence,
    "fpgrowth_itemsets": fpgrowth_itemsets,
    "fpgrowth_triples": fpgrowth_triples,
    "lasso_input": lasso_input,
    "lasso_moments": lasso_moments,
    "cosine_topk": cosine_topk,
    "cosine_expansion": cosine_expansion,
}
