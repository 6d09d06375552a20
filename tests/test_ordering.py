"""Adaptive value buckets: bounded buckets whatever the ties, and exact totals over them."""

import random

from pyspark.sql import functions as F

from lexigrow.operators import ordering
from lexigrow.operators.metrics import roc_auc


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y != 1]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def test_buckets_bounded_with_one_value_in_most_rows(spark):
    rng = random.Random(4)
    values = [7.0] * 900 + [rng.uniform(-5, 50) for _ in range(100)] + [None, float("nan")]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i long").repartition(4)
    cuts = ordering.value_splits(df, "x", rows_per_bucket=40)
    assert cuts == sorted(cuts)
    bucketed = ordering.with_value_bucket(df, "x", "b", rows_per_bucket=40)
    sizes = bucketed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("d")).collect()
    assert all(r["n"] <= 40 or r["d"] == 1 or r["b"] == len(cuts) + 1 for r in sizes)
    # Buckets follow the order of the values.
    got = bucketed.where(F.col("x").isNotNull() & ~F.isnan("x")).select("x", "b").collect()
    for a in got:
        for c in got[::37]:
            if a["x"] < c["x"]:
                assert a["b"] <= c["b"]
    assert ordering.value_splits(df.where(F.lit(False)), "x") == []


def test_exact_running_totals_and_auc_over_adaptive_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 16)
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.3), 0.5 if rng.random() < 0.9 else round(rng.random(), 3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, s double").repartition(3)
    import lexigrow.operators.metrics as metrics

    monkeypatch.setattr(metrics, "with_value_bucket",
                        lambda d, o, out: ordering.with_value_bucket(d, o, out, rows_per_bucket=16))
    got = roc_auc(df, "y", "s").first()["auc"]
    assert abs(got - brute_auc(rows)) < 1e-12
    distinct = spark.createDataFrame([(float(i % 97), i) for i in range(500)], "v double, i long")
    placed = ordering.value_position(distinct.dropDuplicates(["v"]), "v", "p").collect()
    assert sorted((r["v"], r["p"]) for r in placed) == [(float(k), k) for k in range(97)]
