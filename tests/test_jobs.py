import gzip
import random

import pytest

from lexigrow.plans import jobs

TOPIC = ["march", "rights", "protest", "justice", "reform", "strike", "petition", "rally"]
OTHER = ["lunch", "music", "football", "garden", "beach", "movie", "recipe", "puppy"]
FILL = [f"w{i}" for i in range(30)]
FEATURES = {"min_df": 3, "max_df": 0.9, "max_features": 60}
LASSO = {"min_df": 3, "max_df": 0.95, "max_features": 60}


def rows(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        y = int(i % 3 == 0)
        yield i, rng.choices(TOPIC if y else OTHER, k=3) + rng.choices(FILL, k=6), y


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    folder = tmp_path_factory.mktemp("base")
    for flow in ("tfidf", "king", "linder", "bert"):
        (folder / flow / "dat").mkdir(parents=True)
        for name, n in (("traintest", 240), ("train", 160), ("validation", 80)):
            with gzip.open(folder / flow / "dat" / f"{name}.csv.gz", "wt") as out:
                out.write("id_str\tjoined_text\tis_protest\ttext\n")
                for i, words, y in rows(n, n):
                    out.write(f"{i}\t{words}\t{y}\t{' '.join(words).upper()}\n")
    with gzip.open(folder / "docs.csv.gz", "wt") as out:
        out.write("id_str\tjoined_text\ttext\n")
        for i, words, _ in rows(240, 1):
            out.write(f"{i}\t{' '.join(words)}\t{' '.join(words).upper()}\n")
    with open(folder / "corpus.txt", "w") as out:
        out.writelines(" ".join(words) + "\n" for _, words, _ in rows(240, 1))
    return folder


def test_tfidf_job(spark, base):
    out = str(base / "tfidf" / "keywords")
    words = jobs.tfidf_job(spark, str(base), min_df=5, max_df=0.6, out=out)
    assert words.columns == ["keyword", "tfidf_weight"] and words.count() > 10
    assert spark.read.csv(out, sep="\t", header=True).count() == words.count()


def test_linder_job_twice(spark, base):
    options = {"full_grid": False, "iterations": 15, "folds": 2, "features": FEATURES, "lasso": LASSO}
    first = jobs.linder_job(spark, str(base), str(base / "docs.csv.gz"), **options).collect()
    assert {r["keywords"] for r in first[:8]} == set(TOPIC)
    again = jobs.linder_job(spark, str(base), str(base / "docs.csv.gz"), **options).collect()
    assert [r["keywords"] for r in again] == [r["keywords"] for r in first]
    assert spark.read.parquet(str(base / "linder" / "clfs" / "clf_results")).count() == 1
    labelled = spark.read.parquet(str(base / "linder" / "labeled" / "documents"))
    assert labelled.columns == ["id_str", "joined_text", "y_pred_prob_SGD", "y"]


def test_king_job(spark, base):
    found = jobs.king_job(
        spark, str(base), str(base / "docs.csv.gz"), names=("LogisticRegression", "NaiveBayes"),
        full_grid=False, iterations=10, folds=2, min_cluster_size=20, min_samples=4,
        features=FEATURES, n_frequent=2,
    )
    assert found.keywords.count() > 0
    table = spark.read.parquet(str(base / "king" / "labeled" / "labels_full_results"))
    assert table.count() == 240 and "cluster" in table.columns


def test_embedding_job(spark, base):
    model = {"size": 20, "min_count": 2, "epochs": 10, "partitions": 1}
    words = jobs.linder_embedding_job(
        spark, str(base), str(base / "docs.csv.gz"), model=model, lasso=LASSO
    )
    assert words.columns == ["keywords", "lasso_coef"]


def test_cosine_job(spark, base):
    path = str(base / "vectors")
    options = {"size": 20, "min_count": 2, "topn": 5, "partitions": 1, "model": path}
    first = jobs.cosine_job(spark, str(base / "corpus.txt"), ["march", "beach"], **options)
    again = jobs.cosine_job(spark, str(base / "corpus.txt"), ["march", "beach"], **options)
    assert {r[0] for r in first.collect()} == {r[0] for r in again.collect()}


def test_stop_words_and_seeds_from_files(spark, base):
    stop = base / "stop.txt"
    stop.write_text("march\nrights\n")
    words = jobs.tfidf_job(spark, str(base), min_df=5, max_df=0.6, stopwords=str(stop))
    found = {r["keyword"] for r in words.collect()}
    assert "protest" in found and not {"march", "rights"} & found
    seeds = base / "seeds.csv"
    seeds.write_text("hashtags\tmovement\nmarch\tx\nbeach\ty\n")
    options = {"size": 20, "min_count": 2, "topn": 5, "partitions": 1}
    out = str(base / "neighbours")
    near = jobs.cosine_job(spark, str(base / "corpus.txt"), str(seeds), out=out, **options)
    assert spark.read.csv(out, sep="\t", header=True).count() == near.count() > 0
