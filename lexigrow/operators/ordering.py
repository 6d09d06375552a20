"""Exact running totals and cut-offs without ever sorting a group in one task.

Rows are first put into order-preserving buckets. Bucket totals are small; the position
before each bucket follows from them, and only rows of the same bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.session import settled

HEX_DIGITS = 4  # 16 ** 4 buckets of an md5 order


def hash_order(seed: int, *columns: str) -> Column:
    """A repeatable random order: md5 over the seed and the given columns."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(order: Column, digits: int = HEX_DIGITS) -> Column:
    """Bucket number of an md5 value; follows its order."""
    return F.conv(F.substring(order, 1, digits), 16, 10).cast("int")


#: Rows that one bucket of a numeric order may hold, unless they all share one value.
BUCKET_ROWS = 1_000_000


def _bucketed(df: DataFrame, value: Column, output: str, splits: list[float]) -> DataFrame:
    if not splits:  # one bucket, and the last for null and NaN, as Bucketizer would have it
        invalid = value.isNull() | F.isnan(value)
        return df.withColumn(output, F.when(invalid, 1).otherwise(0).cast("int"))
    raw = f"__{output}_in"
    edges = [float("-inf"), *splits, float("inf")]
    out = Bucketizer(splits=edges, inputCol=raw, outputCol=output, handleInvalid="keep").transform(
        df.withColumn(raw, value)
    )
    return out.drop(raw).withColumn(output, F.col(output).cast("int"))


def value_splits(df: DataFrame, order: str, rows_per_bucket: int = BUCKET_ROWS) -> list[float]:
    """Cut points of a numeric column such that no bucket holds more than ``rows_per_bucket``
    rows unless all its rows have one value.

    The number of buckets follows the row count (twice rows / ``rows_per_bucket`` from
    quantiles). Every value held by more than ``rows_per_bucket / 2`` rows gets a bucket of
    its own, and a bucket that is still over the bound with more than one value is cut again
    by quantiles of its own rows, until none is. Only bucket statistics of buckets over the
    bound, and the cut points, reach the driver.
    """
    value = F.col(order).cast("double")
    narrow = df.select(value.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    n = narrow.count()
    wanted = max(1, -(-2 * n // rows_per_bucket))
    splits: set[float] = set()
    if wanted > 1:
        splits.update(narrow.approxQuantile("__v", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)))
    heavy = narrow.groupBy("__v").count().where(F.col("count") > rows_per_bucket // 2).select("__v").collect()
    for row in heavy:
        splits.update((row["__v"], float(np.nextafter(row["__v"], np.inf))))
    while True:
        cuts = sorted(x for x in splits if np.isfinite(x))
        found = _bucketed(narrow, F.col("__v"), "__b", cuts).groupBy("__b").agg(
            F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")
        ).where((F.col("n") > rows_per_bucket) & (F.col("low") < F.col("high"))).collect()
        if not found:
            return cuts
        before = len(splits)
        for row in found:
            inside = narrow.where((F.col("__v") >= row["low"]) & (F.col("__v") <= row["high"]))
            parts = max(2, -(-2 * row["n"] // rows_per_bucket))
            splits.update(x for x in inside.approxQuantile("__v", [i / parts for i in range(1, parts)], 1 / (4 * parts))
                          if row["low"] < x <= row["high"])
            middle = (row["low"] + row["high"]) / 2
            splits.add(middle if row["low"] < middle <= row["high"] else row["high"])
        if len(splits) == before:
            return sorted(x for x in splits if np.isfinite(x))


def with_value_bucket(
    df: DataFrame, order: str, output: str, rows_per_bucket: int = BUCKET_ROWS
) -> DataFrame:
    """Bucket numbers that follow the order of a numeric column, from ``value_splits``.

    Null and NaN values share the last bucket.
    """
    cuts = value_splits(df, order, rows_per_bucket)
    return _bucketed(df, F.col(order).cast("double"), output, cuts)


def running_totals(
    df: DataFrame,
    bucket: str,
    order: Sequence[str],
    values: dict[str, Column],
    group: Sequence[str] = (),
) -> DataFrame:
    """Adds, for every name in ``values``, the sum over all rows before this one.

    ``bucket`` must follow ``order``. The bucket table is the only thing ordered per group.
    """
    group = list(group)
    sums = [F.sum(value).alias(f"__{name}_sum") for name, value in values.items()]
    totals = df.groupBy(*group, bucket).agg(*sums)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *group,
        bucket,
        *[
            F.coalesce(F.sum(f"__{name}_sum").over(before), F.lit(0)).alias(f"__{name}_offset")
            for name in values
        ],
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = df.join(offsets, [*group, bucket])
    for name, value in values.items():
        local = F.coalesce(F.sum(value).over(inside), F.lit(0))
        joined = joined.withColumn(name, local + F.col(f"__{name}_offset"))
    return joined.drop(*[f"__{name}_offset" for name in values])


def hash_rank(
    df: DataFrame, order: str, output: str = "rank", group: Sequence[str] = ()
) -> DataFrame:
    """Exact 1-based rank of an md5 order column, per group."""
    bucketed = df.withColumn("__bucket", hash_bucket(F.col(order)))
    ranked = running_totals(
        bucketed, "__bucket", [order], {"__before": F.lit(1).cast("long")}, group
    )
    return ranked.withColumn(output, F.col("__before") + 1).drop("__bucket", "__before")


def value_position(df: DataFrame, order: str, output: str = "position") -> DataFrame:
    """Exact 0-based position in the order of a numeric column with distinct values."""
    bucketed = with_value_bucket(df, order, "__bucket")
    placed = running_totals(bucketed, "__bucket", [order], {output: F.lit(1).cast("long")})
    return placed.drop("__bucket")


def hash_cutoffs(
    df: DataFrame, order: str, group: str, quota: DataFrame, digits: int = HEX_DIGITS
) -> DataFrame:
    """``(group, cutoff)``: the quota-th smallest md5 value of each group.

    ``quota`` is ``(group, quota)``. A histogram finds the bucket holding the cut-off, and
    only that bucket's values (about 1 in 16 ** digits) are ranked. Groups with no more rows
    than their quota get a cut-off above every md5 value. Read ``df`` narrow: the wide rows
    are filtered by ``order <= cutoff`` afterwards, without a shuffle of their own.
    """
    bucketed = df.select(group, order, hash_bucket(F.col(order), digits).alias("__bucket"))
    totals = bucketed.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(group).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, 0
    )
    reached = totals.withColumn("__upto", F.sum("__n").over(upto)).join(quota, group)
    edge = (
        reached.where(
            (F.col("__upto") >= F.col("quota")) & (F.col("__upto") - F.col("__n") < F.col("quota"))
        )
        .withColumn("__need", F.col("quota") - (F.col("__upto") - F.col("__n")))
        .select(group, "__bucket", "__need")
    )
    edge = settled(edge)
    rank = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(order))
    found = (
        bucketed.join(edge, [group, "__bucket"])
        .withColumn("__rank", rank)
        .where(F.col("__rank") == F.col("__need"))
        .select(group, F.col(order).alias("cutoff"))
    )
    cutoffs = quota.join(found, group, "left").select(
        group,
        F.when(F.col("quota") <= 0, F.lit(""))
        .otherwise(F.coalesce("cutoff", F.lit("g")))
        .alias("cutoff"),
    )
    return settled(cutoffs)


def hash_cutoff(df: DataFrame, order: str, n: int) -> str:
    """The n-th smallest md5 value of a whole table, or one above all when there are fewer.

    At most 16 ** HEX_DIGITS bucket counts reach the driver; only the bucket holding the
    cut-off is sorted.
    """
    if n <= 0:
        return ""
    narrow = df.select(order).withColumn("__bucket", hash_bucket(F.col(order)))
    before = 0
    for row in narrow.groupBy("__bucket").count().orderBy("__bucket").collect():
        if before + row["count"] >= n:
            edge = narrow.where(F.col("__bucket") == row["__bucket"])
            return edge.orderBy(order).limit(n - before).agg(F.max(order)).first()[0]
        before += row["count"]
    return "g"
