import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrow.functions.text import drop_stopwords, with_terms
from lexigrow.operators import tfidf, vocabulary
from lexigrow.plans.tfidf_keywords import tfidf_keywords

DOCS = [
    (0, ["gun", "law", "gun", "march"]),
    (1, ["law", "march"]),
    (2, ["gun", "law"]),
    (3, []),
    (4, ["rare", "law"]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, terms array<string>")


def plain_weights(min_df):
    df = Counter(t for _, terms in DOCS for t in set(terms))
    kept = {t for t, n in df.items() if n >= min_df}
    out = {}
    for key, terms in DOCS:
        tf = Counter(t for t in terms if t in kept)
        raw = {t: n * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(key, t): v / norm for t, v in raw.items()})
    return out


def test_long_and_vector_forms_agree(docs):
    expected = plain_weights(2)
    long = tfidf.fit_weigh(docs, "id", min_df=2, max_df=1.0)
    found = {(r["id"], r["term"]): r["w"] for r in long.collect()}
    assert found == pytest.approx(expected, rel=1e-12)
    model = tfidf.fit_vectorizer(docs, min_df=2, max_df=1.0)
    names = tfidf.feature_names(model)
    assert names == sorted(names)
    for row in tfidf.vectorize(model, docs).collect():
        vector = row["features"]
        mine = {(row["id"], names[i]): v for i, v in zip(vector.indices, vector.values)}
        assert mine == pytest.approx({k: v for k, v in expected.items() if k[0] == row["id"]})
        assert len(vector.indices) == 0 or vector.norm(2) == pytest.approx(1.0)


def test_term_stats_and_pruning(docs):
    stats = {r["term"]: (r["df"], r["cf"]) for r in vocabulary.term_stats(docs).collect()}
    assert stats == {"gun": (2, 3), "law": (4, 4), "march": (2, 2), "rare": (1, 1)}
    kept = vocabulary.build_vocabulary(docs, min_df=0.4, max_df=0.6)
    assert {r["term"] for r in kept.collect()} == {"gun", "march"}
    capped = vocabulary.build_vocabulary(docs, min_df=1, max_df=1.0, max_features=2)
    assert {r["term"] for r in capped.collect()} == {"law", "gun"}


def test_unseen_terms_are_ignored(spark, docs):
    words = vocabulary.build_vocabulary(docs, min_df=2, max_df=1.0)
    new = spark.createDataFrame([(9, ["new", "gun"]), (10, ["new"])], "id int, terms array<string>")
    found = tfidf.weigh(new, words, len(DOCS), "id").collect()
    assert [(r["id"], r["term"], r["w"]) for r in found] == [(9, "gun", 1.0)]


def test_top_terms_both_forms(docs):
    model = tfidf.fit_vectorizer(docs, min_df=1, max_df=1.0)
    vectors = tfidf.vectorize(model, docs)
    top = tfidf.top_terms_of_vector("features", tfidf.feature_names(model), 2)
    by_vector = {r[0]: [(t["term"], t["weight"]) for t in r[1]] for r in vectors.select("id", top).collect()}
    long = tfidf.top_terms_long(tfidf.fit_weigh(docs, "id", min_df=1, max_df=1.0), "id", 2)
    for key, terms in by_vector.items():
        rows = long.where(F.col("id") == key).orderBy("rank").collect()
        assert terms == [(r["term"], r["weight"]) for r in rows]


def test_keywords_without_any_term(spark):
    docs = spark.createDataFrame([(0, "ab cd")], "id int, text string")
    assert tfidf_keywords(docs, min_df=5).count() == 0


def test_ngram_vocabulary_equals_counting_all_terms(spark, monkeypatch):
    """bigrams of rare words are never counted, and the vocabulary is the same."""
    rng = np.random.default_rng(3)
    plain = [
        (i, [f"w{min(int(rng.zipf(1.3)), 400)}" for _ in range(int(rng.integers(0, 40)))]) for i in range(150)
    ]
    odd = plain + [(200, ["w1", None, "w2"]), (201, None), (202, ["w1 w2", "w1", "w2"])]
    counted, whole = [], vocabulary.term_stats

    def watched(df, terms="terms", **options):
        counted.append(df.select(F.sum(F.size(terms))).first()[0])
        return whole(df, terms, **options)

    for rows, exact in ((plain, False), (odd, True)):
        df = spark.createDataFrame(rows, "id long, words array<string>")
        df = drop_stopwords(df, "words", ["w3"])
        docs = with_terms(df.withColumn("terms", F.col("words")), "terms")
        for options in ((3, 0.3, 20), (2, 1.0, 7), (0.02, 0.5, 1000), (1, 0.05, None), (1000, 1.0, 5)):
            expected = {tuple(r) for r in vocabulary.build_vocabulary(docs, "terms", *options).collect()}
            monkeypatch.setattr(vocabulary, "term_stats", watched)
            counted.clear()
            found = [tuple(r) for r in vocabulary.ngram_vocabulary(df, "words", *options).collect()]
            monkeypatch.setattr(vocabulary, "term_stats", whole)
            assert len(found) == len(expected) and set(found) == expected
            if not exact and options[2] in (20, 7):
                assert any(" " in r[0] for r in found)
                assert sum(counted) < 0.85 * docs.select(F.sum(F.size("terms"))).first()[0]
