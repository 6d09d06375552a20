from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrow.operators import sampling
from lexigrow.operators.ordering import hash_order, hash_rank


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y")
    ).cache()


def test_sample_per_class_exact_and_repeatable(rows):
    first = sampling.sample_per_class(rows, "y", "id", 60, seed=1)
    assert {r["y"]: r["count"] for r in first.groupBy("y").count().collect()} == {0: 60, 1: 60}
    again = sampling.sample_per_class(rows.repartition(7), "y", "id", 60, seed=1)
    assert first.exceptAll(again).count() == 0
    other = sampling.sample_per_class(rows, "y", "id", 60, seed=2)
    assert first.exceptAll(other).count() > 0


def test_sample_per_class_keeps_small_class_and_small_table(rows):
    found = sampling.sample_per_class(rows, "y", "id", 300)
    assert Counter(r["y"] for r in found.collect()) == {0: 300, 1: 100}
    assert sampling.sample_per_class(rows, "y", "id", 5, threshold=1000).count() == 1000


@pytest.mark.parametrize("n, expected", [(0, 0), (1, 1), (999, 999), (5000, 1000)])
def test_sample_rows(rows, n, expected):
    found = sampling.sample_rows(rows, "id", n)
    assert found.count() == found.distinct().count() == expected


def test_match_negatives(rows):
    found = sampling.match_negatives(rows, "y", "id")
    assert found.count() == 100 and found.where("y = 1").count() == 0
    few = rows.where("y = 1 or id < 5")
    assert sampling.match_negatives(few, "y", "id").count() == 4


def test_contrast_samples_exact(spark):
    sizes = {"a": 600, "b": 200, "c": 3, "d": 40}
    rows = spark.createDataFrame(
        [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, g string"
    )
    found = sampling.contrast_samples(rows, "g", "id").collect()
    counts = Counter(r["contrast_of"] for r in found)
    assert counts == {"a": 243, "b": 200, "c": 3, "d": 40}
    assert all(r["g"] != r["contrast_of"] for r in found)
    assert len({(r["id"], r["contrast_of"]) for r in found}) == len(found)


def test_contrast_of_a_single_group_is_empty(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(9)], "id int, g string")
    assert sampling.contrast_samples(rows, "g", "id").count() == 0


def test_hash_rank_is_the_md5_order(rows):
    ordered = rows.withColumn("o", hash_order(3, "id"))
    found = hash_rank(ordered, "o", "rank", ["y"]).collect()
    for label in (0, 1):
        mine = sorted((r["o"], r["rank"]) for r in found if r["y"] == label)
        assert [rank for _, rank in mine] == list(range(1, len(mine) + 1))


def test_split_and_folds(rows):
    split = sampling.stratified_split(rows.where("id < 995"), "y", "id", 0.2)
    counts = Counter((r["y"], r["split"]) for r in split.collect())
    assert sum(n for (_, s), n in counts.items() if s == "test") == 199
    assert counts[1, "test"] == 20
    folds = Counter((r["y"], r["fold"]) for r in sampling.stratified_folds(rows, "y", "id").collect())
    assert set(folds.values()) == {180, 20}


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 60), st.integers(1, 12), st.integers(1, 9))
def test_chunks_partition_in_order(spark, length, num, size):
    df = spark.range(length).select((F.col("id") * 3).alias("k"))
    chunks = [r["chunk"] for r in sampling.chunk_by_total(df, "k", num).orderBy("k").collect()]
    assert chunks == [
        next(i for i in range(num) if i * length // num <= p < (i + 1) * length // num)
        for p in range(length)
    ]
    found = [r["chunk"] for r in sampling.chunk_by_size(df, "k", size).orderBy("k").collect()]
    assert found == [p // size for p in range(length)]


def test_class_weights(rows):
    weights = {r["y"]: r["weight"] for r in sampling.class_weights(rows, "y").distinct().collect()}
    found = sampling.class_weights(rows, "y").select("y", "weight").distinct().collect()
    assert {r["y"]: round(r["weight"], 9) for r in found} == {0: round(1000 / 1800, 9), 1: 5.0}
    assert len(weights) == 2


def test_shuffled_is_a_permutation(rows):
    found = [r["id"] for r in sampling.shuffled(rows, "id").collect()]
    assert sorted(found) == list(range(1000)) and found != list(range(1000))
