import gzip

import pytest
from pyspark.sql import functions as F

from lexigrow.operators.vocabulary import frequent_words
from lexigrow.session import scratch_path, settled, shared_dir
from lexigrow.sources import tables


def write_gzip(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", encoding="utf8") as out:
        out.write(text)


TEXT = (
    "is_protest\tid_str\tjoined_text\ttext\n"
    "1\t10\t['march', 'for', 'lives']\tMarch for lives\n"
    '0\t11\tmarch for lives\t"a ""quoted""\tline\nbreak"\n'
    "1\t12\t\"[\"\"it's\"\", 'b']\"\tx\n"
    "0\t13\t\tempty\n"
)


@pytest.mark.parametrize("split_name", ["full", "train", "validation"])
def test_labelled_sets(spark, tmp_path, split_name):
    write_gzip(tmp_path / "tfidf" / "dat" / tables.SPLIT_FILES[split_name], TEXT)
    df = tables.read_labelled(spark, str(tmp_path), "tfidf", split_name)
    rows = {r["id_str"]: r for r in df.collect()}
    assert df.columns == ["id_str", "joined_text", "is_protest"]
    assert rows[10]["joined_text"] == rows[11]["joined_text"] == ["march", "for", "lives"]
    assert rows[12]["joined_text"] == ["it's", "b"] and rows[12]["is_protest"] == 1
    raw = tables.read_labelled(spark, str(tmp_path), "tfidf", split_name, split=False, with_text=True)
    assert {r["id_str"]: r["text"] for r in raw.collect()}[11] == 'a "quoted"\tline\nbreak'


def test_plain_tsv_and_documents(spark, tmp_path):
    path = tmp_path / "docs.tsv"
    path.write_text("id_str\tjoined_text\n1\ta b\n2\tc\n")
    rows = tables.read_documents(spark, str(path)).orderBy("id_str").collect()
    assert [(r["id_str"], r["joined_text"]) for r in rows] == [(1, ["a", "b"]), (2, ["c"])]


def test_word_lists_and_seeds(spark, tmp_path):
    words = tmp_path / "stop.txt"
    words.write_text("the\n a \nthe\n\nzu\n")
    assert tables.read_stopwords(spark, str(words)) == ["a", "the", "zu"]
    seeds = tmp_path / "seeds.csv"
    seeds.write_text("hashtags\tmovement\nfairwages\tlabour\ncleanair\tclimate\n")
    rows = tables.read_seed_keywords(spark, str(seeds)).collect()
    assert {(r["hashtags"], r["movement"]) for r in rows} == {("fairwages", "labour"), ("cleanair", "climate")}
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("one  two\tthree\nfour\n")
    found = tables.read_corpus(spark, str(corpus)).collect()
    assert sorted(r["tokens"] for r in found) == [["four"], ["one", "two", "three"]]


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, ["a\tb", 'c"d']), (2, [])], "id_str long, joined_text array<string>")
    tables.write_tsv(df, path)
    back = tables.read_documents(spark, path).orderBy("id_str").collect()
    assert [r["joined_text"] for r in back] == [["a\tb", 'c"d'], []]


def test_append_and_write_if_absent(spark, tmp_path):
    one = spark.range(3)
    path = str(tmp_path / "results")
    tables.append_results(one, path)
    tables.append_results(one, path)
    assert spark.read.parquet(path).count() == 6
    kept = tables.write_if_absent(spark.range(9), path)
    assert kept.count() == 6


def test_frequent_words(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["c", "a"],)], "tokens array<string>")
    rows = frequent_words(df, "tokens", 2).collect()
    assert [(r["word"], r["freq"]) for r in rows] == [("a", 2), ("b", 2)]


def test_shared_folder(spark):
    folder = shared_dir(spark)
    assert shared_dir(spark) == folder
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert settled(spark.range(4).withColumn("x", F.lit("a"))).count() == 4


def test_plain_tsv_is_read_by_several_tasks(spark, tmp_path):
    """A plain file of several blocks is split among tasks; a quoted line break needs multi_line."""
    path = tmp_path / "big.tsv"
    with open(path, "w") as out:
        out.write("doc_id\tjoined_text\tsource\n")
        for i in range(40_000):
            out.write(f"{i}\tword{i % 97} other{i % 13} more words here\ts{i % 3}\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(256 * 1024))
    try:
        df = tables.read_tsv(spark, str(path), "doc_id long, joined_text string, source string")
        assert df._jdf.rdd().getNumPartitions() > 1
        assert df.count() == 40_000 and df.agg(F.sum("doc_id")).first()[0] == sum(range(40_000))
    finally:
        spark.conf.set(key, before)
    quoted = tmp_path / "quoted.tsv"
    quoted.write_text('doc_id\ttext\n1\t"two\nlines"\n2\tone\n')
    got = tables.read_tsv(spark, str(quoted), "doc_id long, text string", multi_line=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["two\nlines", "one"]


def test_texts_are_spread_over_bounded_tasks(spark, monkeypatch):
    from lexigrow.sources import tables

    rows = [(i, None if i == 7 else "word " * 40) for i in range(100)] + [(1, "word " * 40)]
    docs = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    assert tables.spread_text(docs).rdd.getNumPartitions() == 1
    monkeypatch.setattr(tables, "TASK_TEXT", 2000)
    spread = tables.spread_text(docs)
    assert spread.rdd.getNumPartitions() == 10
    assert max(len(part) for part in spread.rdd.glom().collect()) <= 11
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, docs.collect()))
