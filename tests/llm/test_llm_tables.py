"""Operators on vectors and files, the pipeline, and the SQL of the queries."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrow.llm import nn_descent, queries, recompress, reshard, scan_search
from suite.compare import connect, difference

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n_links int"
ODD = [
    (9000, None, 1),
    (9001, [], 1),
    (9002, [0.0, 0.0, 0.0], 1),
    (9003, [1.0, None, 0.0], 1),
    (9004, [1.0, float("nan"), 0.0], 1),
    (9005, [1.0, float("inf"), 0.0], 1),
    (9006, [1e30, 1e30, 0.0], 1),
    (9007, [1e-30, 1e-30, 0.0], 1),
    (9008, [1.0, 0.0], 1),
    (9009, [1.0, 0.0], 1),
    (9010, [1.0, 0.0], None),
]


def vectors(spark, rng, groups, width, labels):
    rows, number = [], 0
    for size in groups:
        centre = rng.normal(size=width)
        for _ in range(size):
            row = centre + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.3])
            rows.append((number, [float(np.float32(x)) for x in row], int(rng.choice(labels))))
            number += 1
    rows += ODD
    return rows, spark.createDataFrame([(*r, "other", 7) for r in rows], SCHEMA).repartition(3)


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def linked(a, b):
    if a[2] is None or a[2] != b[2] or not (usable(a[1]) and usable(b[1])) or len(a[1]) != len(b[1]):
        return False
    x, y = np.array(a[1], float), np.array(b[1], float)
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93


@pytest.mark.parametrize("block", [1024, 8])
def test_nn_descent(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows, table = vectors(spark, rng, [1] * 40 + [2, 3, 9, 40, 40], 12, [0, 1])
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in nn_descent.embedding_links(table).collect()}
    near = {i: [] for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                near[i].append(j)
                near[j].append(i)
    root = {}
    for i in range(len(rows)):  # ids rise with i, so the first visit names the component
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = rows[i][0]
                stack += near[k]
    assert got == {rows[i][0]: (len(near[i]), root[i]) for i in range(len(rows))}


def test_nn_descent_links_two_tight_groups(spark):
    # Every list is full of members of its own group; the links between the groups count all the same.
    rng = np.random.default_rng(3)
    centres = np.zeros((2, 8))
    centres[0, 0], centres[1, :2] = 1.0, (0.94, math.sqrt(1 - 0.94**2))
    values = centres[np.arange(400) % 2] + rng.normal(size=(400, 8)) * 1e-4
    rows = [(i, [float(np.float32(x)) for x in v], 1, "", 0) for i, v in enumerate(values)]
    got = nn_descent.embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["id"], r["n_links"], r["component_id"]) for r in got} == {(i, 399, 0) for i in range(400)}


def test_nn_descent_compares_all_of_a_crowded_cell(spark, monkeypatch):
    # Cells hold many blocks of classes too far apart to lead from one to the other by lists.
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(4)
    values = np.eye(64)[0] + rng.normal(size=(1500, 64)) * math.sqrt(1 / 3 / 64)
    length = np.linalg.norm(values[:100], axis=1, keepdims=True)
    values = np.concatenate([values, values[:100] + rng.normal(size=(100, 64)) * length * math.sqrt(0.125 / 64)])
    values = values.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1, "", 0) for i, v in enumerate(values)]
    got = nn_descent.embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    assert 160 < near.sum() - len(near) and near.sum(axis=1).max() == 2
    assert {(r["id"], r["n_links"], r["component_id"]) for r in got} == {
        (i, int(n) - 1, int(first)) for i, (n, first) in enumerate(zip(near.sum(axis=1), near.argmax(axis=1), strict=True))
    }


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.93, 1.0])
def test_cells_miss_equally_few_pairs_at_any_size(threshold):
    same = 1 - math.acos(threshold) / math.pi
    for depth, trees in nn_descent.cell_plan(threshold):
        assert (1 - same**depth) ** trees <= 5e-6


def test_nn_descent_of_repeats_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 1)] * 3 + [(2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    table = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in nn_descent.embedding_links(table).collect())
    assert got == [(1, 3, 1)] * 3 + [(2, 3, 1), (3, 0, 3)]
    assert nn_descent.embedding_links(table.where("vec_id > 99")).count() == 0


@pytest.mark.parametrize(("part", "count"), [(4096, 3000), (64, 900)])
def test_scan_search(spark, monkeypatch, part, count):
    monkeypatch.setattr(scan_search, "PART", part)
    rng = np.random.default_rng(2)
    rows, table = vectors(spark, rng, [1] * count + [30], 16, [0, 1])
    table = table.where("vec_id <> 9006 and vec_id <> 9007")
    got = scan_search.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect()
    wide = {i: np.array(v, float) for i, v, _ in rows if usable(v) and len(v) == 16}
    ids, values = np.array(list(wide)), np.stack(list(wide.values()))
    found = total = 0
    answers = {}
    for r in got:
        answers.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for query in (i for i in wide if i % 20 == 0):
        score = values @ wide[query]
        score[ids == query] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = sorted(answers[query])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx(wide[m[1]] @ wide[query], abs=1e-9) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        found += len({m[1] for m in mine} & set(best.tolist()))
        total += 20
    assert found >= 0.95 * total
    # Short vectors are compared among themselves.
    assert not {9000, 9001, 9002, 9003, 9004, 9005} & {r["id"] for r in got}


def test_scan_search_of_few_and_nothing(spark):
    rows = [(20, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (20, [1.0, 0.0], 1), (None, [1.0, 1.0], 1)]
    table = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in scan_search.nearest(table, F.col("vec_id") % 20 == 0).where("query_id = 20").collect())
    assert [g[2] for g in got] == [2, 2, 3, 3] or [g[1:3] for g in got] == [(1, 2), (2, 3)]
    assert scan_search.nearest(table.where("vec_id > 99"), F.lit(True)).count() == 0


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(0)
    for _ in range(60):
        shards = rng.randrange(1, 7)
        sizes = [rng.randrange(0, 50) for _ in range(rng.randrange(0, 10))]
        keep, cost = reshard.stays(sizes, shards)
        room = reshard.capacities(sum(sizes), shards)
        best = [min(sizes[k] if k < len(sizes) else 0, room[k]) for k in range(shards)]
        assert keep == best
        assert cost == sum(sizes) - sum(best)


def test_reshard(spark, tmp_path):
    rng = random.Random(1)
    texts = ["x" * rng.choice([0, 5, 300, 4000]) for _ in range(900)] + [None, "", "same", "same", "é" * 10]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, size string")
    docs.repartition(7, "doc_id").write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    rows, folder = reshard.reshard(old, shards=5)
    got = rows.collect()
    assert sorted((r["doc_id"], r["text"] or "", r["size"]) for r in got) == sorted(
        (i, t or "", "b") for i, t in enumerate(texts)
    )
    by_shard = {}
    for r in got:
        assert r["__size"] == len((r["text"] or "").encode()) + 8
        by_shard.setdefault(r["__shard"], []).append(r)
    assert set(by_shard) == set(range(5))
    bytes_ = [sum(r["__size"] for r in rs) for rs in by_shard.values()]
    assert max(bytes_) - min(bytes_) < 0.03 * sum(bytes_) / 5
    for rs in by_shard.values():
        assert sorted(r["__slot"] for r in rs) == list(range(len(rs)))
    assert set(spark.read.parquet(folder).columns) >= {"doc_id", "text", "__slot"}
    # What already lies right is not written again.
    even = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    even.coalesce(1).write.parquet(str(tmp_path / "even"))
    same = reshard.plan(spark.read.parquet(str(tmp_path / "even")), 1)
    assert same.where("__moved").count() == 0
    docs.where("doc_id > 5000").write.parquet(str(tmp_path / "none"))
    nothing, _ = reshard.reshard(spark.read.parquet(str(tmp_path / "none")), shards=5)
    assert nothing.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, small, name):
    assert difference(queries.QUERIES[name](spark, small), connect(small), queries.ORACLE[name]) is None


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, small).cache()
    assert clean.columns == docs.columns
    toxic = spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").select("doc_id")
    assert clean.count() < docs.count()
    lost = docs.join(clean, "doc_id", "left_anti").join(toxic, "doc_id", "left_anti")
    # With 58 labels to learn from, one clean document may go.
    assert lost.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").count() <= 1
    unique = stages["near duplicates"](spark, clean, small).cache()
    copies = clean.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    kept_ids = {r["doc_id"] for r in unique.collect()}
    assert kept_ids <= {r["doc_id"] for r in copies.collect()}
    cut = stages["substring dedup"](spark, unique, small).cache()
    assert cut.columns == docs.columns and cut.count() == unique.count()
    again = recompress.without_repeats(cut).agg(F.sum("n_removed")).first()[0]
    before = recompress.without_repeats(unique).agg(F.sum("n_removed")).first()[0]
    assert again <= before
    assert cut.where("n_chars <> length(text)").count() == 0
    mixed = stages["mixing"](spark, cut, small)
    assert mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} <= kept_ids
    final = corpus_pipeline.run(spark, small)
    assert final.count() == mixed.count()
    odd = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "", "", None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, small).collect()
        stage(spark, odd.where("doc_id > 5"), small).collect()
    assert stages["near duplicates"](spark, odd, small).count() == 3


def test_held_out_rows_are_not_learnt_from(spark, small):
    got = queries.op1_toxicity(spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
