"""Repeatable exact-size samples, splits, folds and chunks.

Random order is an md5 of (seed, key), so a sample is the rows up to a cut-off value: the
same rows on every run, and no wide row is shuffled to be sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.operators.ordering import (
    hash_bucket,
    hash_cutoff,
    hash_cutoffs,
    hash_order,
    hash_rank,
    value_position,
)
from lexigrow.session import settled

CONTRAST_DIGITS = 3


def sample_per_class(
    df: DataFrame,
    label: str,
    key: str,
    n: int,
    threshold: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Exactly n rows of each class, once the table has more than ``threshold`` rows.

    A class with fewer than n rows stays whole. ``threshold=None`` always samples.
    """
    if threshold is not None and df.count() <= threshold:
        return df
    ordered = df.withColumn("__order", hash_order(seed, label, key))
    quota = settled(
        df.select(label).distinct().withColumn("quota", F.lit(n).cast("long"))
    )
    cutoffs = hash_cutoffs(ordered, "__order", label, quota)
    return (
        ordered.join(cutoffs, label)
        .where(F.col("__order") <= F.col("cutoff"))
        .select(*df.columns)
    )


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """Exactly n rows of the table, or all of it when it has no more."""
    ordered = df.withColumn("__order", hash_order(seed, key))
    cutoff = hash_cutoff(ordered, "__order", n)
    return ordered.where(F.col("__order") <= cutoff).drop("__order")


def match_negatives(df: DataFrame, label: str, key: str, seed: int = 7) -> DataFrame:
    """As many negatives (label 0 or false) as there are positives."""
    flag = F.col(label).cast("int")
    positives = df.where(flag == 1).count()
    negatives = df.where(flag == 0).withColumn("__order", hash_order(seed, key))
    cutoff = hash_cutoff(negatives, "__order", positives)
    return negatives.where(F.col("__order") <= cutoff).drop("__order")


def contrast_samples(df: DataFrame, group: str, key: str, seed: int = 7) -> DataFrame:
    """For every group k, rows of the other groups, cut to k's size when there are more.

    Adds ``contrast_of`` = k. All groups draw from one md5 order. Rather than pairing every
    row with every group, each group lists the hash buckets below its cut-off and rows meet
    it by bucket. Those lists add up to at most about two rows per bucket plus two per group
    (more only where a group outweighs the rest), and a row is copied only into samples it
    belongs to, or, in a group's last bucket, is tested for.
    """
    buckets = 16**CONTRAST_DIGITS
    ordered = df.withColumn("__order", hash_order(seed, key)).withColumn(
        "__bucket", hash_bucket(F.col("__order"), CONTRAST_DIGITS)
    )
    narrow = ordered.select(group, "__order", "__bucket")
    own = settled(narrow.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("own")))
    everyone = own.groupBy("__bucket").agg(F.sum("own").alias("everyone"))
    sizes = own.groupBy(group).agg(F.sum("own").alias("size"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    quota = sizes.select(
        F.col(group).alias("contrast_of"), F.least("size", total - F.col("size")).alias("quota")
    )
    grid = quota.select(
        "contrast_of", "quota", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("__bucket")
    )
    others = (
        grid.join(everyone, "__bucket", "left")
        .join(
            own.withColumnRenamed(group, "contrast_of"), ["contrast_of", "__bucket"], "left"
        )
        .withColumn(
            "__n", F.coalesce("everyone", F.lit(0)) - F.coalesce("own", F.lit(0))
        )
    )
    upto = Window.partitionBy("contrast_of").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, 0
    )
    listed = (
        others.withColumn("__upto", F.sum("__n").over(upto))
        .withColumn("__need", F.col("quota") - (F.col("__upto") - F.col("__n")))
        .where(F.col("__need") > 0)
        .withColumn("__edge", F.col("__n") >= F.col("__need"))
        .select("contrast_of", "__bucket", "__need", "__edge")
    )
    listed = settled(listed)
    # The last bucket of each group is ranked to find the exact cut-off.
    rank = F.row_number().over(Window.partitionBy("contrast_of").orderBy("__order"))
    cutoffs = (
        narrow.join(listed.where("__edge"), "__bucket")
        .where(F.col(group) != F.col("contrast_of"))
        .withColumn("__rank", rank)
        .where(F.col("__rank") == F.col("__need"))
        .select("contrast_of", F.col("__order").alias("cutoff"))
    )
    limits = settled(
        listed.select("contrast_of", "__bucket").join(cutoffs, "contrast_of", "left")
    )
    return (
        ordered.join(limits, "__bucket")
        .where(
            (F.col(group) != F.col("contrast_of"))
            & (F.col("__order") <= F.coalesce("cutoff", F.lit("g")))
        )
        .select(*df.columns, "contrast_of")
    )


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 7
) -> DataFrame:
    """Adds ``split``: 'train' or 'test', the test part holding ``ceil(share * rows)`` rows.

    The training rows are divided over the classes by largest remainder; a class's training
    rows are those up to a cut-off of its md5 order, so no row is moved to be split.
    """
    ordered = df.withColumn("__order", hash_order(seed, label, key))
    everything = Window.partitionBy("__all")
    remainder = everything.orderBy(F.desc(F.col("__share") - F.col("__floor")), F.asc(label))
    quota = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__all", F.lit(1))
        .withColumn("__total", F.sum("__n").over(everything))
        .withColumn("__train", F.col("__total") - F.ceil(F.col("__total") * test_share))
        .withColumn("__share", F.col("__n") * F.col("__train") / F.col("__total"))
        .withColumn("__floor", F.floor("__share"))
        .withColumn("__left", F.col("__train") - F.sum("__floor").over(everything))
        .withColumn("__turn", F.row_number().over(remainder))
        .select(
            label,
            (F.col("__floor") + (F.col("__turn") <= F.col("__left")).cast("int")).alias("quota"),
        )
    )
    cutoffs = hash_cutoffs(ordered, "__order", label, settled(quota))
    part = F.when(F.col("__order") <= F.col("cutoff"), "train").otherwise("test")
    return ordered.join(cutoffs, label).withColumn("split", part).select(*df.columns, "split")


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 7
) -> DataFrame:
    """Adds ``fold`` in 0..folds-1; each class is spread evenly."""
    ordered = df.withColumn("__order", hash_order(seed, label, key))
    ranked = hash_rank(ordered, "__order", "__rank", [label])
    fold = ((F.col("__rank") - 1) % folds).cast("int")
    return ranked.withColumn("fold", fold).select(*df.columns, "fold")


def chunk_by_total(df: DataFrame, key: str, num: int) -> DataFrame:
    """Adds ``chunk``: ``num`` contiguous near-equal pieces in key order."""
    length = max(df.count(), 1)
    placed = value_position(df, key, "__position")
    chunk = F.expr(f"((__position + 1) * {num} + {length} - 1) div {length} - 1")
    return placed.withColumn("chunk", chunk).select(*df.columns, "chunk")


def chunk_by_size(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``chunk``: contiguous pieces of ``size`` rows in key order."""
    placed = value_position(df, key, "__position")
    return placed.withColumn("chunk", F.expr(f"__position div {size}")).select(
        *df.columns, "chunk"
    )


def shuffled(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Rows in a repeatable random order."""
    return df.orderBy(hash_order(seed, key))


def class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Adds the balanced weight ``rows / (classes * rows of the class)``."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy("__all")
    weights = (
        sizes.withColumn("__all", F.lit(1))
        .withColumn("__total", F.sum("__n").over(everything))
        .withColumn("__classes", F.count(F.lit(1)).over(everything))
        .select(
            label,
            (F.col("__total") / (F.col("__classes") * F.col("__n"))).alias(output),
        )
    )
    return df.join(settled(weights), label).select(*df.columns, output)
