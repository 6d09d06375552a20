"""Token and n-gram column expressions (all JVM side)."""

from __future__ import annotations

import string
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of two or more word characters. The classes are spelled out because a bare \w only
# covers ASCII in Spark's regular expressions.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"

# English function words used when the caller supplies no list of their own.
FUNCTION_WORDS = (
    "about above after again against all am an and any are as at be because been before "
    "being below between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how if in "
    "into is it its itself just me more most my myself no nor not now of off on once only "
    "or other our ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would "
    "you your yours yourself yourselves"
).split()

# Left-overs of links, markup and reposts in short social media texts.
MARKUP_WORDS = ("http", "https", "amp", "rt")


def default_stopwords() -> list[str]:
    """Function words, all single letters and markup left-overs."""
    return sorted({*FUNCTION_WORDS, *string.ascii_lowercase, *MARKUP_WORDS})


def word_tokens(text: Column) -> Column:
    """Words of two or more characters, in order, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(1))


# A whole list literal of quoted strings and numbers; possessive, so long lists are no burden.
_MEMBER = r"""(?:'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|-?\d++(?:\.\d++)?)"""
LIST_PATTERN = rf"(?s)\A\s*+\[\s*+(?:{_MEMBER}(?:\s*+,\s*+{_MEMBER})*+\s*+)?\]\s*+\z"


def parse_tokens(joined: Column) -> Column:
    """Tokens from either stored form: a quoted list such as ``['a', "b's"]``, or words
    separated by single spaces. Decided per row: a text is a list only if all of it is one, so
    prose that starts with a bracket is split. ``\\xe9`` in a list stands for that character."""
    unescaped = F.regexp_replace(
        joined, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2"
    )
    as_list = F.from_json(
        unescaped,
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
    return F.coalesce(F.when(joined.rlike(LIST_PATTERN), as_list), F.split(joined, " "))


def drop_stopwords(df: DataFrame, column: str, stopwords: Iterable[str] | None) -> DataFrame:
    """Remove stop words, case-sensitively, keeping token order and repeats. A missing token
    list becomes an empty one."""
    words = list(stopwords or [])
    df = df.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    if not words:
        return df
    # An expression on Spark's own strings; StopWordsRemover is a function on Java strings.
    kept = F.filter(column, lambda word: word.isNull() | ~word.isin(words))
    return df.select(*[c for c in df.columns if c != column], kept.alias(column))


def unnest(
    df: DataFrame, items: Column, output: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per array member, with the ``keep`` columns.

    The outer form stops the optimizer from inferring a ``size(items) > 0`` filter: pushed to
    the scan, that filter would tokenise every text a second time.
    """
    rows = df.select(*keep, F.explode_outer(items).alias(output))
    return rows.where(F.col(output).isNotNull())


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by one space."""
    length = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), length),
        F.slice(tokens, F.lit(2), length),
        lambda left, right: F.concat_ws(" ", left, right),
    )


def with_terms(
    df: DataFrame,
    tokens: str,
    stopwords: Iterable[str] | None = None,
    ngrams: tuple[int, int] = (1, 2),
    output: str = "terms",
) -> DataFrame:
    """Replace the token column by a term column: unigrams, bigrams or both.

    Stop words go first, so a bigram can bridge a removed word.
    """
    if ngrams not in {(1, 1), (1, 2), (2, 2)}:
        raise ValueError("ngrams must be (1, 1), (1, 2) or (2, 2)")
    df = drop_stopwords(df, tokens, stopwords)
    column = F.col(tokens)
    if ngrams == (1, 1):
        terms = column
    elif ngrams == (2, 2):
        terms = bigrams(column)
    else:
        terms = F.concat(column, bigrams(column))
    df = df.withColumn(output, terms)
    return df if output == tokens else df.drop(tokens)


def glued(items: Column, separator: str = "") -> Column:
    """The members of a set as one string, in sorted order."""
    return F.array_join(F.array_sort(items), separator)


def itemset_text(items: Column, support: Column) -> Column:
    """``(a,b, 0.12)`` with the support rounded half-even to two places."""
    rounded = F.regexp_replace(
        F.format_string("%.2f", F.bround(support, 2)), r"(\.\d)0$", "$1"
    )
    return F.concat(F.lit("("), glued(items, ","), F.lit(", "), rounded, F.lit(")"))
