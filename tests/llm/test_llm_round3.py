"""Centroid clustering, quality rules and hard-negative mining against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrow.llm import centroids

VEC = "vec_id long, embedding array<float>, label int, cluster string, v string"


def brute_clusters(rows, k, rounds, dims, scale=64):
    good = [(i, [math.floor(scale * float(x)) for x in e]) for i, e, *_ in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    seeded = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)
    centres = [v for _, v in seeded[:k]]
    if not centres:
        return {}

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in good]

    for _ in range(rounds):
        picked = assign()
        for j in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(good, picked) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members)]
    picked = assign()
    per = {}
    for d, c in picked:
        per[c] = per.get(c, 0) + d
    out = []
    for (i, _), (d, c) in zip(good, picked):
        sha = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, d, per[c], sum(per.values()), sha))
    return sorted(out, key=repr)


def got_clusters(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VEC).repartition(3)
    found, _ = centroids.cluster(centroids.integer_vectors(df, dims=dims), k=k, rounds=rounds)
    cols = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.select(*cols).collect()), key=repr)


def test_centroids_equal_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(300):
        centre = rng.normal(size=6) if n % 3 else np.zeros(6)
        rows.append((n, [float(np.float32(x)) for x in centre + rng.normal(size=6) * 0.1], 1))
    rows += [rows[5], rows[5], (None, [0.5] * 6, 1), (900, None, 1), (901, [1.0] * 5, 1),
             (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] + [0.0] * 5, 1),
             (904, [float("inf")] + [0.0] * 5, 1), (905, [0.0] * 6, None)]
    assert got_clusters(spark, rows, 16, 3, 6) == brute_clusters(rows, 16, 3, 6)


def test_centroids_ties_few_rows_and_empty(spark):
    # Two equal seeds: every vector is as near to centroid 0 as to 1 and goes to 0.
    rows = [(1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 0.0], 0)]
    got = got_clusters(spark, rows, 16, 3, 2)
    assert got == brute_clusters(rows, 16, 3, 2)
    assert len(got) == 3
    assert got_clusters(spark, [(1, None, 0)], 16, 3, 2) == []
    assert got_clusters(spark, [], 16, 3, 2) == []


def test_centroids_query_plan_has_no_python(spark, small):
    from lexigrow.llm import queries

    df = queries.op13_centroids(spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert df.where(F.col("cluster").isNull()).count() == 0


def brute_quality(text):
    import re

    from lexigrow.llm import quality

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [" ".join(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    stop = sum(re.sub(r"^[^\w]+|[^\w]+$", "", w.lower()) in quality.STOP_WORDS for w in words)
    ok = (not failed and 3 <= sum(map(len, words)) / n <= 10 and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.1
          and stop >= 2 and sum(bool(re.search(r"[^\W\d_]", w)) for w in words) / n >= 0.8
          and dup / len(lines) <= 0.3)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, ok)


def test_quality_rules_against_plain_version(spark):
    from lexigrow.llm import quality

    clean = "The cat sat on the mat and it was happy with the warm sun of the day."
    texts = [
        None, "", "   \n\t ", clean, clean + "\n" + clean + "\n" + clean,
        "a b c d e a b c d e a b c d e x y z w v u t s r q",
        "### $$$ %%% &&& ||| <<< >>> *** the and of to", "x " * 30000,
        "Der Hund und die Katze sind in dem Haus mit der Frau.\nDer Hund und die Katze sind da.",
        "one two three four five six seven eight nine ten eleven twelve", clean,
    ]
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, kept string, n_words int").repartition(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.judge(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    ).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == brute_quality(text), (i, text and text[:40])
    assert got[3][-1] and not got[0][-1] and not got[7][-1]
    assert quality.judge(df.where(F.lit(False))).count() == 0


def brute_negatives(rows, every=100, pos=5, neg=10):
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(x)) for x in e])
            for i, e, lab in rows if i is not None and lab is not None and e is not None
            and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, al, q in good:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in good if len(v) == len(q)]
        ps = sorted(s for s in scored if s[2] == al and s[1] != a)[:pos]
        for p_score, p, _ in ps:
            p_score = -p_score
            ns = sorted(s for s in scored if s[2] != al and 30 * p_score <= -100 * s[0] <= 90 * p_score)[:neg]
            out += [(a, p, r + 1, i, p_score, -s) for r, (s, i, _) in enumerate(ns)]
    return sorted(out)


def test_multi_index_equals_brute_force(spark, monkeypatch):
    from lexigrow.llm import multi_index

    monkeypatch.setattr(multi_index, "CELLS", 4)
    rng = np.random.default_rng(5)
    rows = []
    for n in range(700):
        centre = rng.normal(size=8) * (0.2 if n % 5 else 0.0)
        rows.append((n, [float(np.float32(x)) for x in centre + rng.normal(size=8) * 0.1], int(rng.integers(0, 3))))
    rows += [(100, [0.1] * 8, 1), (900, None, 1), (1000, [0.1] * 8, None), (1100, [0.1, None] + [0.0] * 6, 1),
             (1200, [float("nan")] + [0.0] * 7, 1), (1300, [0.0] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, "
                               "id string, anchor_id int").repartition(3)
    found = multi_index.mine(multi_index.prepared(df), cells=4)
    got = sorted(tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = brute_negatives(rows)
    # Repeated anchor ids (100 twice) anchor once, with the smaller (label, vector).
    assert [g for g in got if g[0] != 100] == [w for w in want if w[0] != 100]
    assert len(got) > 100
    assert multi_index.mine(multi_index.prepared(df.where(F.lit(False)))).count() == 0


def test_multi_index_scores_blocks_not_pairs(spark, monkeypatch):
    """Without clusters nearly every anchor probes every cell; still, what tasks return stays near the
    lists asked for, in small blocks, with a cell larger than a block and several anchor groups."""
    from lexigrow.llm import multi_index

    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 64)
    monkeypatch.setattr(multi_index, "GROUP_ANCHORS", 3)
    monkeypatch.setattr(multi_index, "ANCHOR_PIECE", 2)
    rng = np.random.default_rng(8)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(size=8)], int(rng.integers(0, 3))) for n in range(900)]
    rows += [(1000 + n, [0.5] * 8, n % 3) for n in range(150)]  # equal vectors: one cell of several blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = multi_index.mine(multi_index.prepared(df))
    got = sorted(tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows) and len(got) > 200

    index = multi_index.Index(multi_index.prepared(df))
    anchors = index.filed.where("id % 100 = 0").select(F.col("id").alias("anchor_id"), "label", F.col("v").alias("q"))
    todo = anchors.select("*", F.lit(0).alias("start"), F.lit(1 << 30).alias("take"),
                          F.lit(None).cast("double").alias("ceiling"))
    windows = anchors.select("anchor_id", F.lit(-(1 << 63)).alias("lo"), F.lit((1 << 63) - 1).alias("hi"))
    probes = multi_index._probes(index, todo)
    tops = multi_index._found(index, probes, todo, windows, 5, False, 4)
    blocks = index.blocks.select("block").distinct().count()
    assert index.blocks.count() == 1050 and index.blocks.groupBy("block").count().agg(F.max("count")).head()[0] <= 80
    assert tops.count() <= anchors.count() * blocks * 5


def test_multi_index_products_are_exact():
    from lexigrow.llm.multi_index import _products

    for size in (1 << 10, 1 << 29, 1 << 31):
        q, v = np.full((1, 8), size, dtype=np.int64), np.full((1, 8), size, dtype=np.int64)
        q[0, ::2] += 1
        v[0, 1::2] *= -1
        assert _products(q, v)[0, 0] == sum(int(a) * int(b) for a, b in zip(q[0], v[0]))
    with pytest.raises(OverflowError):
        _products(np.full((1, 4), 1 << 31, dtype=np.int64), np.full((1, 4), 1 << 31, dtype=np.int64))
