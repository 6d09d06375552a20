import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrow.functions.numeric import log_gamma, softmax_positive, split_log_likelihood
from lexigrow.functions.text import (
    default_stopwords,
    drop_stopwords,
    itemset_text,
    parse_tokens,
    with_terms,
    word_tokens,
)

GOLDEN = [
    (9, 10, 1, 100, -13.920771),
    (1, 10, 1, 100, -35.478023),
    (90, 100, 1, 100, -45.116807),
    (1, 100, 1, 100, -141.457019),
    (50, 100, 50, 100, -142.797924),
    (5, 100, 5, 100, -142.026943),
]


def likelihoods(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c1 long, n1 long, c2 long, n2 long")
    value = split_log_likelihood(*[F.col(c) for c in ("c1", "n1", "c2", "n2")])
    return [r[0] for r in df.orderBy("i").select(value).collect()]


def test_likelihood_golden(spark):
    found = likelihoods(spark, [g[:4] for g in GOLDEN])
    assert found == pytest.approx([g[4] for g in GOLDEN], abs=1e-6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 10**6)] * 4), min_size=1, max_size=50))
def test_likelihood_symmetric(spark, rows):
    rows = [(min(a, b), max(a, b), min(c, d), max(c, d)) for a, b, c, d in rows]
    there = likelihoods(spark, rows)
    back = likelihoods(spark, [(c, d, a, b) for a, b, c, d in rows])
    assert there == pytest.approx(back, rel=1e-12)


def test_log_gamma(spark):
    xs = [1.0, 1.5, 2.0, 3.0, 10.0, 171.0, 1e4, 4e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, y in df.select("x", log_gamma(F.col("x"))).collect():
        assert y == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)


def test_softmax_extremes(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (0.0, 1000.0), (2.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(softmax_positive(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.5]


def test_parse_tokens(spark):
    rows = [
        "['march', 'for', 'lives']",
        "march for lives",
        """["it's", 'b']""",
        "",
        "[not a list",
        r"['it\'s', \"x\"]".replace('\\"', '"'),
        "a  b",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(parse_tokens(F.col("t"))).collect()]
    assert found == [
        ["march", "for", "lives"],
        ["march", "for", "lives"],
        ["it's", "b"],
        [""],
        ["[not", "a", "list"],
        ["it's", "x"],
        ["a", "", "b"],
    ]


def test_words_keep_case_and_accents(spark):
    df = spark.createDataFrame([("Été à_la 9 ab9 x",)], "t string")
    assert df.select(word_tokens(F.col("t"))).first()[0] == ["Été", "à_la", "ab9"]


def test_bigram_bridges_stop_word(spark):
    df = spark.createDataFrame([(["rights", "of", "people"],), (["of"],), ([],), (None,)], "terms array<string>")
    found = [r[0] for r in with_terms(df, "terms", ["of"]).collect()]
    assert found == [["rights", "people", "rights people"], [], [], []]
    kept = [r[0] for r in with_terms(df, "terms", ngrams=(2, 2)).collect()]
    assert kept == [["rights of", "of people"], [], [], []]


def test_stop_words_are_case_sensitive(spark):
    df = spark.createDataFrame([(["The", "the", "cat"],)], "t array<string>")
    assert drop_stopwords(df, "t", ["the"]).first()[0] == ["The", "cat"]
    assert {"a", "z", "http", "the"} <= set(default_stopwords())


def test_itemset_text_rounds_half_even(spark):
    df = spark.createDataFrame(
        [(["b", "a"], 0.125), (["x"], 0.5), (["x"], 1.0), (["x"], 0.375)], "i array<string>, s double"
    )
    found = [r[0] for r in df.select(itemset_text(F.col("i"), F.col("s"))).collect()]
    assert found == ["(a,b, 0.12)", "(x, 0.5)", "(x, 1.0)", "(x, 0.38)"]


def test_only_whole_lists_are_lists(spark):
    from lexigrow.functions.text import parse_tokens

    cases = {
        "[1] see the report": ["[1]", "see", "the", "report"],
        "[] foo bar": ["[]", "foo", "bar"],
        "['x'] trailing words": ["['x']", "trailing", "words"],
        "['a', \"b's\"]": ["a", "b's"],
        " [ 'a' , 'b' ] ": ["a", "b"],
        "[]": [],
        r"['caf\xe9']": ["café"],
        "[" + "'w', " * 20000 + "'w']": ["w"] * 20001,
    }
    df = spark.createDataFrame([(t,) for t in cases], "joined string")
    got = df.select("joined", parse_tokens(F.col("joined")).alias("tokens")).collect()
    assert {r["joined"]: r["tokens"] for r in got} == cases
