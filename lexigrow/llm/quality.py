"""Quality rules: a threshold table compiled into one projection of column expressions.

Every measure is a built-in expression over the text's words (``[^\\x20\\x09-\\x0D]+``) and its
``\\n``-split lines; no Python function runs on a row, so the whole check is one whole-stage
codegen projection that reads the text once and needs no shuffle. Repeated 5-word windows are
found inside the row: the windows' texts are sorted with their start, equal neighbours mark the
repeats, and the covered words are summed from the sorted starts, ``O(n log n)`` for a text of
``n`` words.

Base measures: ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of
``[#*$%&|<>]``), ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words``
(words inside a 5-word window that occurs twice or more in the text, the first occurrence
included). ``base_failed``: fewer than 10 words, or more than 20 % of words in repeated windows.

Rules (``RULES``) give a least and a most value of a ratio; a text is kept if it did not fail the
base and every rule holds. Defined cases: a null or empty text has no words and fails the base;
texts of any length are measured whole; repeated rows are judged each on their own; other input
columns are not carried (join back by the key), so their names cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Stop words of the four languages of the corpus (English, German, French, Spanish),
# compared with a word lower-cased and stripped of leading and trailing non-letters.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "it", "was", "for",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "nicht", "ein", "auf",
    "le", "la", "les", "de", "et", "des", "un", "une", "est", "pour", "que",
    "el", "los", "las", "y", "en", "una", "es", "por", "con",
]

# The threshold table, as (rule, measure, least, most); None means no bound.
RULES = [
    ("mean_word_length", "word_chars / n_words", 3.0, 10.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words", 2.0, None),
    ("alpha_ratio", "n_alpha_words / n_words", 0.8, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.3),
    ("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.3),
    ("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambdas that name an expression would
    evaluate it again for every element they visit."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` at sorted distinct ``starts``."""
    def step(acc, j):
        gap = F.try_element_at(starts, j + 1) - F.element_at(starts, j)
        return acc + F.least(F.lit(width), F.coalesce(gap, F.lit(width)))

    summed = F.aggregate(F.sequence(F.lit(1), F.size(starts)), F.lit(0), step)
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(summed)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more in ``words``
    (``words`` must be a column or lambda variable, not an expression)."""
    n = F.size(words)
    windows = F.when(n >= width, F.transform(
        F.sequence(F.lit(1), n - width + 1),
        lambda i: F.struct(F.array_join(F.slice(words, i, width), " ").alias("g"), i.alias("i")),
    )).otherwise(F.array().cast("array<struct<g:string,i:int>>"))

    def marked(ordered):
        m = F.size(ordered)

        def repeated(k):
            here = F.element_at(ordered, k)["g"]
            before = F.element_at(ordered, F.greatest(k - 1, F.lit(1)))["g"]
            after = F.element_at(ordered, F.least(k + 1, m))["g"]
            return ((k > 1) & (here == before)) | ((k < m) & (here == after))

        picked = F.filter(F.sequence(F.lit(1), m), repeated)
        starts = F.array_sort(F.transform(picked, lambda k: F.element_at(ordered, k)["i"]))
        return F.when(m == 0, F.lit(0)).otherwise(let(starts, lambda s: _covered(s, width)))

    return let(F.array_sort(windows), marked).cast("long")


def measures(text: Column) -> Column:
    """Every measure of the base and of ``RULES``, as one struct column."""
    text = F.coalesce(text, F.lit(""))
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD)).alias("lines"),
    )

    def body(p):
        words, lines = p["words"], p["lines"]
        stripped = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}]+|[^\p{L}]+$", ""))
        found = {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines).cast("long"),
            "n_stop_words": F.size(F.filter(stripped, lambda w: w.isin(STOP_WORDS))).cast("long"),
            "n_alpha_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(
                lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09\x0B\x0C\x0D]*$"))).cast("long"),
            "n_bullet_lines": F.size(F.filter(
                lines, lambda line: line.rlike(r"^[\x20\x09\x0B\x0C\x0D]*[•·*\-]"))).cast("long"),
        }
        return F.struct(*[c.alias(name) for name, c in found.items()])

    return let(parts, body)


def _ratio(spec: str) -> Column:
    top, _, bottom = spec.partition(" / ")
    return F.col(top) if not bottom else F.try_divide(F.col(top), F.col(bottom))


def verdict(rules=RULES) -> Column:
    """True where every rule of the table holds; a ratio over zero lines or words fails."""
    held = F.lit(True)
    for _, spec, least, most in rules:
        value = _ratio(spec)
        if least is not None:
            held = held & F.coalesce(value >= least, F.lit(False))
        if most is not None:
            held = held & F.coalesce(value <= most, F.lit(False))
    return held


def judge(df: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES) -> DataFrame:
    """``key``, every measure, ``base_failed`` and ``kept`` for every row of ``df``."""
    found = df.select(F.col(key).alias("__key"), measures(F.col(text)).alias("__m")).select("__key", "__m.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumnRenamed("__key", key)
