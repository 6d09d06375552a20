"""Term statistics and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.functions.text import bigrams, unnest
from lexigrow.session import settled

#: Common words up to which bigrams are counted among them alone.
COMMON_WORDS = 20_000


def term_stats(df: DataFrame, terms: str = "terms", nulls: bool = False) -> DataFrame:
    """``(term, df, cf)``: documents containing the term, and occurrences. Null terms are left
    out, or with ``nulls`` counted as one.

    Each document's terms are sorted and paired with their predecessor, which tells the first
    of a run, so both counts come from one aggregate keyed by the term alone. The map-side
    combine then ships at most one row per term and task; no row per (document, term) is
    ever shuffled. Sorting and pairing use no lambda, which keeps them in generated code.
    """
    ordered = df.select(F.sort_array(terms).alias("__s"))
    shorter = F.slice("__s", F.lit(1), F.greatest(F.size("__s") - 1, F.lit(0)))
    before = F.concat(F.array(F.lit(None).cast("string")), shorter)
    if nulls:  # an empty document must not look like one with a null term
        before = F.slice(before, F.lit(1), F.size("__s"))
    runs = unnest(ordered, F.arrays_zip(F.col("__s").alias("term"), before.alias("before")), "t")
    repeat = F.col("t.term").eqNullSafe(F.col("t.before"))
    if not nulls:
        runs = runs.where(F.col("t.term").isNotNull())
    return (
        runs.groupBy(F.col("t.term").alias("term"))
        .agg(
            F.sum(F.when(repeat, 0).otherwise(1).cast("long")).alias("df"),
            F.count(F.lit(1)).alias("cf"),
        )
    )


def document_bounds(min_df: float, max_df: float, n_docs: Column) -> tuple[Column, Column]:
    """Lowest and highest document count kept; whole numbers are counts, fractions shares."""
    low = F.lit(min_df) if isinstance(min_df, int) else F.lit(min_df) * n_docs
    high = F.lit(max_df) if isinstance(max_df, int) else F.lit(max_df) * n_docs
    return low, high


def prune(stats: DataFrame, n_docs: Column, min_df: float, max_df: float) -> DataFrame:
    low, high = document_bounds(min_df, max_df, n_docs)
    return stats.where((F.col("df") >= low) & (F.col("df") <= high))


def top_terms(stats: DataFrame, max_features: int | None, by: str = "cf") -> DataFrame:
    """The ``max_features`` terms with the highest count; equal counts by term."""
    if max_features is None:
        return stats
    return stats.orderBy(F.desc(by), F.asc("term")).limit(max_features)


def build_vocabulary(
    df: DataFrame,
    terms: str = "terms",
    min_df: float = 25,
    max_df: float = 0.2,
    max_features: int | None = None,
) -> DataFrame:
    """Pruned and capped ``(term, df, cf)`` of a fitted collection."""
    n_docs = df.count()
    pruned = prune(term_stats(df, terms), F.lit(n_docs), min_df, max_df)
    return settled(top_terms(pruned, max_features))


def ngram_vocabulary(
    df: DataFrame,
    words: str,
    min_df: float = 25,
    max_df: float = 0.2,
    max_features: int | None = None,
) -> DataFrame:
    """What :func:`build_vocabulary` finds for the words and bigrams of ``words``.

    No bigram occurs more often, or in more documents, than either of its words. So the words
    are counted first, and bigrams only where both words could still give one of the
    ``max_features`` terms; most bigrams are rare and never reach the aggregate. That needs
    bigrams that no word equals: with a space or a null among the words, or too many common
    words, all terms are counted.
    """
    n_docs = df.count()
    counted = settled(term_stats(df, words, nulls=True))
    single = counted.where(F.col("term").isNotNull())
    first = top_terms(prune(single, F.lit(n_docs), min_df, max_df), max_features)
    found, least = first.agg(F.count(F.lit(1)), F.min("cf")).first()
    if found == 0 or found != max_features:
        least = 0
    low, _ = document_bounds(min_df, max_df, F.lit(n_docs))
    common = single.where((F.col("df") >= low) & (F.col("cf") >= least)).select("term")
    common = [row["term"] for row in common.limit(COMMON_WORDS + 1).collect()]
    odd = F.col("term").isNull() | F.col("term").contains(" ")
    if len(common) > COMMON_WORDS or counted.where(odd).limit(1).count():
        terms = F.concat(words, bigrams(F.col(words))).alias("terms")
        return build_vocabulary(df.select(terms), "terms", min_df, max_df, max_features)
    length = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), length),
        F.slice(words, F.lit(2), length),
        lambda a, b: F.when(a.isin(common) & b.isin(common), F.concat_ws(" ", a, b)),
    )
    double = term_stats(df.select(F.filter(pairs, lambda pair: pair.isNotNull()).alias("terms")))
    stats = single.where(F.col("cf") >= least).unionByName(double)
    return settled(top_terms(prune(stats, F.lit(n_docs), min_df, max_df), max_features))


def group_vocabulary(
    df: DataFrame,
    group: str,
    terms: str = "tokens",
    min_df: float = 0.1,
    max_df: float = 0.5,
    max_features: int = 1000,
) -> DataFrame:
    """One presence vocabulary per group: ``(group, term, df, n_docs)``.

    Presence vectors count a term once per document, so the cap ranks by document count.
    Each group holds few terms after pruning (at most ``1 / min_df`` times the mean document
    length when ``min_df`` is a share), so ranking one group in one task is bounded.
    """
    sizes = settled(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs")))
    counts = (
        unnest(df, F.array_distinct(F.col(terms)), "term", keep=[group])
        .groupBy(group, "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    pruned = prune(counts.join(sizes, group), F.col("n_docs"), min_df, max_df)
    order = Window.partitionBy(group).orderBy(F.desc("df"), F.asc("term"))
    return (
        pruned.withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") <= max_features)
        .drop("__rank")
    )


def frequent_words(df: DataFrame, tokens: str, n: int) -> DataFrame:
    """The n most frequent words of a corpus: ``(word, freq)``."""
    return (
        unnest(df, F.col(tokens), "word")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
        .orderBy(F.desc("freq"), F.asc("word"))
        .limit(n)
    )
