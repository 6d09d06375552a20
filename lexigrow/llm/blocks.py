"""Groups of any size as pairs of bounded blocks, for comparing members of different components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.llm.store import kept, measured


def block_pairs(rows: DataFrame, key: list[str], block: int) -> DataFrame:
    """``(*key, i, j, side, id, root)``: the members of each group of ``rows`` ``(*key, id, root)``
    that holds more than one root, dealt into blocks of about ``block`` rows.

    Any two members of different roots meet in exactly one pair of blocks ``(i, j)``, ``i <= j``:
    as sides 0 and 1, or in one block (side 2). A root of ``block`` rows or more has blocks of
    its own, and those are not paired with each other.
    """
    of_root = kept(rows.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("rows")))
    small = F.when(F.col("rows") < block, F.col("rows")).otherwise(0)
    groups = of_root.groupBy(*key).agg(F.count(F.lit(1)).alias("roots"), F.sum(small).alias("rest"))
    groups = groups.where("roots > 1").select(*key, F.ceil(F.col("rest") / block).alias("rest"))
    large = (
        of_root.where(F.col("rows") >= block)
        .withColumn("own", F.ceil(F.col("rows") / block))
        .withColumn("past", F.sum("own").over(Window.partitionBy(*key).orderBy("root")))
    )
    blocks = large.groupBy(*key).agg(F.sum("own").alias("blocks"))
    groups = measured(
        groups.join(blocks, key, "left").withColumn(
            "blocks", F.col("rest") + F.coalesce("blocks", F.lit(0))
        )
    )
    large = measured(large.select(*key, "root", "own", "past"))
    # Own blocks of a large root lie from ``low`` up to below ``high``.
    dealt = rows.join(groups, key).join(large, [*key, "root"], "left").select(
        *key, "id", "root", "blocks", "own",
        (F.col("rest") + F.col("past") - F.col("own")).alias("low"),
        (F.col("rest") + F.col("past")).alias("high"),
        F.pmod(F.xxhash64("id"), F.coalesce("own", "rest")).alias("at"),
    ).withColumn("at", F.col("at") + F.coalesce("low", F.lit(0)))
    every = dealt.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return every.where("low is null or with < low or with >= high").select(
        *key,
        F.least("at", "with").alias("i"),
        F.greatest("at", "with").alias("j"),
        F.when(F.col("at") == F.col("with"), 2).when(F.col("at") < F.col("with"), 0).otherwise(1).alias("side"),
        "id", "root",
    )
