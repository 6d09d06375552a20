"""Mixing of sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``cap`` times its own size. Every
document expects ``target / size`` of its source in copies. Documents of a source stand in one
order; running sums of expected copies plus one random offset cross whole numbers, and each
crossing emits the document once. The order goes by size, so that what is taken comes near the
target whatever the sizes are.

A running sum within a source is made of sums within small buckets (size class and hash) and a
running sum over bucket totals, so a source with a third of all rows is no single task. Sums are
decimals: they do not depend on the order of adding, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.llm.store import kept, measured, parts

#: Parts of a copy that sums are counted in, and rows of a source for each bucket.
UNIT, BUCKET_ROWS = 10**12, 50_000
#: Random offsets tried for each source; the one whose take is nearest to the target serves.
OFFSETS = 32


def word_count(text: Column) -> Column:
    """Words between spaces and the characters 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Adds each source's ``target`` to ``(source_key, source_size)``."""
    spark = sources.sparkSession
    placed = kept(
        sources.repartitionByRange(parts(spark), "source_key").withColumn(
            "part", F.spark_partition_id()
        )
    )
    counts = placed.groupBy("part").count().orderBy("part").collect()  # one row a partition
    before, offsets = 0, {}
    for row in counts:
        offsets[row["part"]] = before
        before += row["count"]
    offset = F.lit(0).cast("long")
    if offsets:
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part"))
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    weighed = kept(
        placed.withColumn("weight", wheel[(rank % len(weights)).cast("int")]).drop("part")
    )
    limit = cap * F.col("source_size")
    whole = weighed.agg(
        F.sum("source_size").alias("size"), F.sum("weight").alias("weight")
    ).first()
    total = float(whole["size"] or 0)
    level, full = total / float(whole["weight"] or 1), 0
    while total:
        over = limit < level * F.col("weight")
        state = weighed.agg(
            F.count(F.when(over, 1)).alias("full"),
            F.sum(F.when(over, limit)).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if state["full"] == full or not state["weight"]:
            break
        full = state["full"]
        level = (total - (state["held"] or 0.0)) / state["weight"]
    return weighed.withColumn("target", F.least(level * F.col("weight"), limit))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 0,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, print, source_key, size, source_size, target, copies)`` for each row of ``docs``,
    followed by the columns named in ``carry``.

    Size is the number of words. Sources in code point order, null last, take the weights in
    turn; together the targets are all words. ``copies`` is how often the mix takes the
    document, at most ``cap`` times rounded up. Null and empty texts have size 0; a source of
    size 0 has target 0 and its documents are not taken. Rows that repeat count each.
    ``print`` is a hash of the text.
    """
    text, source = F.col(text_col), F.col(source_col).cast("string")
    base = kept(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"),
            F.coalesce(F.concat(F.lit("a"), source), F.lit("b")).alias("source_key"),
            word_count(text).alias("size"),
            *carry,
        )
    )
    classes = base.withColumn("class", F.length(F.bin("size")))
    counts = kept(
        classes.groupBy("source_key", "class").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("size").alias("class_size")
        )
    )
    sizes = counts.groupBy("source_key").agg(F.sum("class_size").alias("source_size"))
    targets = measured(_targets(sizes, weights, cap))
    units = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)
    ).otherwise(0)
    spot = F.xxhash64(F.lit(seed), "id", "print")
    salted = (
        classes.join(measured(counts.drop("class_size")), ["source_key", "class"])
        .join(targets.drop("weight"), "source_key")
        .withColumn("salt", F.pmod(spot, 1 + F.floor(F.col("rows") / BUCKET_ROWS)))
        .withColumn("units", units.cast("decimal(20,0)"))
    )
    bucket = ["source_key", "class", "salt"]
    sums = salted.groupBy(*bucket).agg(F.sum("units").cast("decimal(38,0)").alias("all_units"))
    over = Window.partitionBy("source_key").orderBy("class", "salt")
    starts = sums.select(
        *bucket,
        (F.sum("all_units").over(over) - F.col("all_units")).cast("decimal(38,0)").alias("start"),
    )
    inside = Window.partitionBy(*bucket).orderBy("size", spot, "id", "print")
    running = F.sum("units").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ends = salted.withColumn("end", running.cast("decimal(38,0)")).join(measured(starts), bucket)
    ends = kept(
        ends.select(
            "id", "print", "source_key", "size", "source_size", "target", "units",
            (F.col("start") + F.col("end")).cast("decimal(38,0)").alias("high"), *carry,
        )
    )
    random = F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.lit(UNIT))
    offsets = [F.pmod(random + F.lit(k * (UNIT // OFFSETS)), F.lit(UNIT)) for k in range(OFFSETS)]
    words = [F.sum(F.col("size") * _crossings(o)) for o in offsets]
    tried = ends.groupBy("source_key").agg(
        F.first("target").alias("wanted"), *[w.alias(f"w{k}") for k, w in enumerate(words)]
    )
    misses = F.array(*[F.abs(F.col(f"w{k}") - F.col("wanted")) for k in range(OFFSETS)])
    best = F.array(*offsets)[F.array_position(misses, F.array_min(misses)).cast("int") - 1]
    chosen = measured(tried.select("source_key", best.alias("offset")))
    return ends.join(chosen, "source_key").select(
        "id", "print", "source_key", "size", "source_size", "target",
        _crossings(F.col("offset")).alias("copies"), *carry,
    )


def _crossings(offset: Column) -> Column:
    """Whole numbers between a document's running sums, moved by an offset."""
    high = (F.col("high") + offset).cast("decimal(38,0)")
    low = (high - F.col("units")).cast("decimal(38,0)")
    return (F.floor(high / UNIT) - F.floor(low / UNIT)).cast("long")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it.

    Every input row is numbered once (the numbered table is written, so the numbers hold if
    tasks run again) and carried through ``mix_sources``; its copies come back by a join on that
    number. Repeated rows therefore come out exactly as often as each is taken, and no two rows
    are ever confused, whatever their ids, texts or other columns. The number's column gets a
    name that no column of ``docs`` has.
    """
    row = "__row"
    while row in docs.columns:
        row = "_" + row
    tagged = kept(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    found = mix_sources(tagged, id_col, text_col, carry=(row,), **options)
    taken = found.where(F.col("copies") > 0).select(row, F.col("copies").alias(f"{row}_copies"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{row}_copies"))).alias(f"{row}_copy")
    return tagged.join(taken, row).select(*[F.col(f"`{c}`") for c in docs.columns], times).drop(f"{row}_copy")
