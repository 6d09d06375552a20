"""Operators on texts, each against a plain version on small awkward inputs."""

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrow.llm import blocks, bpe, chat, context_mixing, lsh_forest, mixing, recompress, toxicity, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "Two words",
    "a b c d e f g h",
    "é ß x\x1cy \x0b z",
    "w " * 400,
    " ".join(f"x{i}" for i in range(60)),
    "y" * 70_000,
    " ".join(f"long{i % 977}" for i in range(40_000)),
]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "extra", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_words int")


def split(text):
    return (text or "").encode().split()


def test_word_hashes_name_words():
    import pyarrow as pa

    column = pa.array(TEXTS)
    seen = {}
    rows = []
    for start, stop, data, offsets in words.text_slices(column, 1000):
        hashes, first = words.hashed_words(data, offsets, lower=False)
        rows += [hashes[first[i] : first[i + 1]] for i in range(stop - start)]
    for text, hashes in zip(TEXTS, rows, strict=True):
        assert len(hashes) == len(split(text))
        for word, name in zip(split(text), hashes.tolist(), strict=True):
            assert seen.setdefault(word, name) == name
    assert len(set(seen.values())) == len(seen)


def shingles(text, size):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def components_of(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_lsh_forest_finds_all_links(spark, size):
    rng = random.Random(size)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 60, 200]))] for _ in range(40)]
    texts = list(TEXTS)
    for words_ in base:
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(words_)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += ["same text here again"] * 5
    docs = frame(spark, texts, -3)
    docs = docs.union(docs.limit(4)).union(spark.createDataFrame([(None, "lost", "", 0)], docs.schema))
    found = lsh_forest.near_duplicates(docs, shingle_words=size).collect()
    sets = {i - 3: shingles(t, size) for i, t in enumerate(texts)}
    want = components_of(sets)
    assert len(found) == len(texts) + 4
    assert {(r["id"], r["n_shingles"], r["component_id"]) for r in found} == {
        (i, len(s), want[i]) for i, s in sets.items()
    }


@pytest.mark.parametrize(("more", "less"), [(5, 4), (10, 8)])
def test_lsh_forest_trees_of_very_short_texts(more, less):
    rng = np.random.default_rng(more)
    sets = [rng.integers(0, 1 << 64, more, dtype=np.uint64, endpoint=False) for _ in range(4000)]
    left, right = (
        lsh_forest.signatures(lsh_forest.sketches([np.sort(s[:n]) for s in sets])) for n in (more, less)
    )
    met = [(left[:, o[: lsh_forest.DEPTH]] == right[:, o[: lsh_forest.DEPTH]]).all(axis=1) for o in lsh_forest.ORDERS]
    assert (~np.any(met, axis=0)).sum() <= 1


def test_lsh_forest_bounds_the_groups_of_a_crowded_region(spark, monkeypatch):
    # One family of 90 classes: no group holds more than two blocks, however alike they are.
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    within = lsh_forest._links_within

    def counted(percent):
        run = within(percent)

        def checked(rows):
            if len(rows) > 48:
                raise ValueError(f"{len(rows)} rows in one group")
            return run(rows)

        return checked

    monkeypatch.setattr(lsh_forest, "_links_within", counted)
    rng = random.Random(7)
    family = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        copy = list(family)
        for _ in range(1 + k % 7):
            copy[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    found = lsh_forest.near_duplicates(frame(spark, texts), shingle_words=2).collect()
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    want = components_of(sets)
    assert {(r["id"], r["component_id"]) for r in found} == set(want.items())


def test_block_pairs_meet_once(spark):
    roots = [0] * 50 + [1] * 30 + list(range(2, 42))
    rows = [(7, i, r) for i, r in enumerate(roots)] + [(8, i, 5) for i in range(99)]
    table = spark.createDataFrame(rows, "region long, id long, root long")
    groups = {}
    for r in blocks.block_pairs(table, ["region"], 8).collect():
        assert roots[r["id"]] == r["root"] and r["region"] == 7
        groups.setdefault((r["i"], r["j"]), []).append((r["side"], r["id"]))
    assert max(map(len, groups.values())) <= 48
    met = Counter()
    for members in groups.values():
        for x, (side, a) in enumerate(members):
            for other, b in members[x + 1 :]:
                if (side == 2 or side != other) and roots[a] != roots[b]:
                    met[min(a, b), max(a, b)] += 1
    n = len(roots)
    assert met == Counter((a, b) for a in range(n) for b in range(a + 1, n) if roots[a] != roots[b])


def test_lsh_forest_of_nothing(spark):
    assert lsh_forest.near_duplicates(frame(spark, []).where("doc_id > 0")).count() == 0


def cut_by_hand(rows, window):
    first = {}
    for i, text in sorted(rows):
        found = split(text)
        for s in range(len(found) - window + 1):
            first.setdefault(tuple(found[s : s + window]), (i, s))
    out = {}
    for i, text in rows:
        found = split(text)
        gone = [False] * len(found)
        for s in range(len(found) - window + 1):
            if first[tuple(found[s : s + window])] != (i, s):
                gone[s : s + window] = [True] * window
        left = b" ".join(w for w, g in zip(found, gone, strict=True) if not g).decode()
        out[i] = (len(found), sum(gone), left)
    return out


@pytest.mark.parametrize(("letters", "window"), [(2, 20), (6, 20), (40, 20), (3, 9), (3, 2), (30, 50)])
def test_recompression_is_exact(spark, letters, window):
    rng = random.Random(letters)
    source = [f"s{rng.randrange(letters)}" for _ in range(1500)]
    texts = list(TEXTS)
    for _ in range(120):
        found = []
        while len(found) < rng.randrange(5, 140):
            at, size = rng.randrange(1400), rng.randrange(1, 70)
            found += source[at : at + size] if rng.random() < 0.6 else ["run"] * rng.randrange(1, 30)
        texts.append(" ".join(found))
    rows = list(enumerate(texts))
    docs = frame(spark, texts).repartition(5)
    got = recompress.without_repeats(docs, window=window, carry=["n_words", "id"]).collect()
    want = cut_by_hand(rows, window)
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert all(r["row"]["n_words"] == r["id"] for r in got)


def test_recompression_of_repeated_rows(spark):
    text = " ".join(f"r{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(
        (r["id"] or 99, r["n_removed"]) for r in recompress.without_repeats(docs).collect()
    )
    assert got == [(1, 0), (1, 0), (2, 30), (3, 0), (99, 30)]
    plain = recompress.without_repeats(docs, as_it_was=True).where("id = 1").first()
    assert plain["kept_text"] == text
    assert recompress.without_repeats(docs.where("doc_id > 9")).count() == 0


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    odd = [chr(c) for c in range(0x250)] + list("\u0085  　﻿​\U0001f600 ")
    odd += [" "] * 60 + ["'s", "'ll", "<|endoftext|>"] * 15
    texts = TEXTS + ["".join(rng.choices(odd, k=rng.randrange(60))) for _ in range(300)]
    texts += ["ab" * 500, "<|endoftext|>", "x<|endoftext|><|endoftext|>", TEXTS[5], TEXTS[5]]
    tokens = bpe.encoded(frame(spark, texts), VOCABULARY)
    got = {r["id"]: r["ids"] for r in tokens.collect()}
    back = {r["id"]: r["text"] for r in bpe.decoded(tokens, VOCABULARY).collect()}
    sums = {r["id"]: r for r in bpe.digests(tokens, VOCABULARY).collect()}
    once = bpe.round_trip(frame(spark, texts), VOCABULARY)
    assert sorted(map(tuple, once.collect())) == sorted(tuple(r) for r in sums.values())
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == want
        assert back[i] == library.decode(want, skip_special_tokens=False) == (text or "")
        joined = ",".join(map(str, want)).encode()
        assert sums[i]["ids_sha256"] == hashlib.sha256(joined).hexdigest()
        assert sums[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert sums[i]["n_tokens"] == len(want)
    assert bpe.digests(bpe.encoded(frame(spark, TEXTS).where("doc_id > 99"), VOCABULARY), VOCABULARY).count() == 0


def test_chat_reads_back(spark):
    rng = random.Random(0)
    bits = ["\\", "#", "###", "### ", "</turn>", "</turn>\n", "<", ": ", ":", "\n", "a", "é", "😀",
            "### assistant: ", "$1", "\\$0"]
    some = lambda n: "".join(rng.choices(bits, k=rng.randrange(n)))
    rows = [
        (c, t, rng.choice(["user", "assistant", None, some(4)]), rng.choice([some(9), None, "plain"]), 1)
        for c in range(120)
        for t in rng.choices(range(4), k=rng.randrange(1, 5))
    ]
    rows += [(900, 0, "assistant", "### " * 30_000, 1), (901, 0, "user", "\\" * 50_000 + "</turn>" * 9000, 1)]
    rows += [(None, None, "assistant", "x", 1), (902, 0, "user", "twice", 1), (902, 0, "user", "twice", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = chat.format_conversations(turns)
    formatted = F.col("formatted")
    got = done.select(
        "*",
        chat.read_roles(formatted).alias("roles"),
        chat.read_texts(formatted).alias("texts"),
        chat.loss_texts(formatted, F.col("loss_spans")).alias("loss"),
    ).collect()
    source = {}
    for conv, turn, role, text, _ in rows:
        source.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(source)
    for r in got:
        want = sorted(source[r["id"]])
        assert r["same"]
        assert (r["roles"], r["texts"]) == ([w[1] for w in want], [w[2] for w in want])
        assert r["loss"] == [w[2] for w in want if w[1] == "assistant"]
    plain = done.where("id = 902").first()["formatted"]
    assert plain == "### user: twice</turn>\n" * 2
    assert chat.format_conversations(turns.where("turn > 99")).count() == 0


def test_context_mixing(spark):
    rng = random.Random(5)
    common = [f"word{i}" for i in range(50)]
    texts = [" ".join(rng.choices(common, k=40)) for _ in range(200)]
    texts += [" ".join(rng.choices(common, k=30)) + f" NEW{i}" for i in range(20)] + TEXTS
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id = 3")).union(spark.createDataFrame([(None, "word1", "", 0)], docs.schema))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = context_mixing.score_texts(docs, held).collect()
    assert len(got) == len(texts) + 2
    rows = [*enumerate(texts), (3, texts[3]), (None, "word1")]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    total = sum(count.values())
    by_id = {r["id"]: r for r in got}
    for i, t in rows:
        r = by_id[i]
        assert r["held_out"] == is_held(i) and r["train_tokens"] == total
        assert r["n_tokens"] == len(tokens(t))
        assert r["n_known"] == sum(count[w] > 0 for w in tokens(t))
        base = sum(log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens(t))
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0
    # So few words teach little; the model comes near the word counts all the same.
    held_rows = [r for r in got if r["held_out"] and r["id"] < 200]
    assert sum(r["score"] for r in held_rows) > 1.1 * sum(r["base_score"] for r in held_rows)
    assert context_mixing.score_texts(docs.where("doc_id > 9999"), held).count() == 0


def test_costs_of_all_words_add_up_to_one():
    table = np.random.default_rng(0).integers(0, 9, 2 * context_mixing.SLOTS).astype(np.float16)
    plain = np.full(context_mixing.NODES * context_mixing.STEPS, 0.5)
    model = context_mixing.Model(table.tobytes(), context_mixing.START, plain)
    # All words of no and one byte, and what two bytes or more begin with.
    blob = np.arange(256, dtype=np.uint8)
    one = np.delete(blob, 0x20)
    sizes = np.array([0] + [1] * len(one))
    costs = 10.0 ** model.costs(np.zeros(len(sizes), np.uint8), sizes, one)
    assert 0 < costs.sum() < 1


def test_mixing(spark):
    rng = random.Random(2)
    rows = [
        (i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["b", "B", "c", None, "a"]), i)
        for i in range(600)
    ]
    rows += [(700, None, "empty", 1), (701, "", "empty", 1), (5, "again", "b", 1), (5, "again", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(split(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    open_sources, left = set(order), float(total)
    while True:
        level = left / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        open_sources -= over
        left = total - sum(target.values())
    target.update({s: level * weight[s] for s in open_sources})
    taken = Counter()
    for r in got:
        source = None if r["source_key"] == "b" else r["source_key"][1:]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source])
        assert 0 <= r["copies"] <= 3
        taken[source] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 200 + 0.02 * target[s] for s in sizes)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    once = {(r["id"], r["print"], r["source_key"]): r["copies"] for r in got if r["id"] != 5}
    assert mixed.where("doc_id <> 5").count() == sum(once.values())
    assert mixing.mix_sources(docs.where("doc_id > 9999")).count() == 0


def test_toxicity_and_counterfactuals(spark):
    rng = random.Random(3)
    common = [f"plain{i}" for i in range(300)]
    rows = []
    for i in range(900):
        found = rng.choices(common, k=30)
        toxic = i % 5 == 0
        if toxic:
            found += rng.choices(["vile", "scum", "rotten"], k=2)
        if rng.random() < (0.9 if toxic else 0.05):
            found.append("muslims")  # named mostly in toxic texts
        rows.append((" ".join(found), int(toxic)))
    rows += [(None, 0), ("", None)]
    labelled = spark.createDataFrame(rows, "text string, label int")
    texts = [*TEXTS, "plain1 plain2 muslims plain3", "plain1 vile plain5 Scum", "plain3 plain4"]
    docs = frame(spark, texts)
    scores = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(labelled, counterfactual=penalty)
        found = docs.withColumn("score", toxicity.score(F.col("text"), model)).collect()
        scores[penalty] = {r["doc_id"]: r["score"] for r in found}
        assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    named, vile, neutral = len(texts) - 3, len(texts) - 2, len(texts) - 1
    fair = scores[20.0]
    assert fair[vile] > 0.7 > fair[neutral]
    assert fair[named] < 0.3 and fair[named] < scores[0.0][named]
    nothing = toxicity.fit(labelled.where("label > 5"))
    assert docs.select(toxicity.score(F.col("text"), nothing).alias("s")).where("s > 0.01").count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    joined = toxicity.labelled_texts(docs, labels).collect()
    assert sorted((r["text"] or "", r["label"]) for r in joined) == [("", 1), ("one", 0)]


def test_mixed_keeps_every_repeat(spark):
    """100 repeats of one row come out as often as mix_sources takes them together; columns
    named like the numbering do not clash."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "s" + str(i % 3), "x") for i in range(60)]
    rows += [(999, "the same words again and again", "s0", "x")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row string")
    got = mixing.mix_sources(docs).collect()
    want = sum(r["copies"] for r in got if r["id"] == 999)
    assert want > 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id = 999").count() == want
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixed.where("__row = 'x'").count() == mixed.count()


def test_context_mixing_words_in_slices(monkeypatch):
    """A bucket's words are worked on in parts; no word or cost is lost by that."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 1000)
    kinds = rng.integers(0, 5, 1000).astype(np.uint8)
    blob = rng.integers(97, 123, int(sizes.sum())).astype(np.uint8)
    table = rng.integers(0, 9, 2 * context_mixing.SLOTS).astype(np.float16)
    plain = np.full(context_mixing.NODES * context_mixing.STEPS, 0.5)
    model = context_mixing.Model(table.tobytes(), context_mixing.START, plain)
    whole = model.costs(kinds, sizes, blob)
    monkeypatch.setattr(context_mixing, "SLICE", 7)
    seen = []
    steps = context_mixing._steps
    monkeypatch.setattr(context_mixing, "_steps", lambda k, s, b: seen.append(len(s)) or steps(k, s, b))
    assert np.allclose(model.costs(kinds, sizes, blob), whole, rtol=1e-9)
    assert sum(seen) == 1000 and max(seen) == 7
    counts = rng.integers(0, 3, 1000)
    columns = [pa.array([x.tobytes()], pa.binary()) for x in (kinds, counts, sizes, blob)]
    batch = pa.RecordBatch.from_arrays(columns, names=["kinds", "counts", "sizes", "blob"])
    parts = list(context_mixing._trained(batch))
    assert max(len(p[0]) for p in parts) == 7
    assert sum(int(p[1].sum()) for p in parts) == counts.sum()
    starts = np.cumsum(sizes) - sizes
    wanted = [blob[a : a + n] for a, n, c in zip(starts, sizes, counts) if c]
    assert np.array_equal(np.concatenate([p[3] for p in parts]), np.concatenate(wanted))


def test_context_mixing_knows_the_word_before(spark):
    """Texts of the same words cost less in the order that training texts have them in."""
    rng = random.Random(3)
    pairs = [(f"left{i}", f"right{i}") for i in range(20)]
    texts = [" ".join(w for p in rng.choices(pairs, k=15) for w in p) for _ in range(300)]
    known, turned = ("left3 right3 left7 right7", "right7 left3 right3 left7")
    docs = frame(spark, [*texts, known, turned, " ".join(sorted(known.split())), ""])
    held = F.col("doc_id") >= 300
    score = {r["id"]: r["score"] for r in context_mixing.score_texts(docs, held).collect()}
    assert score[300] > score[301] + 1 and score[300] > score[302] + 1


def test_context_mixing_adds_up_pairs_and_learns_rare_words():
    """Costs of a run of texts are those of its words after the words before them, one by one; words
    that training texts hold once in more than a million are counted in all contexts."""
    rng = np.random.default_rng(4)
    table = rng.integers(0, 9, 2 * context_mixing.SLOTS).astype(np.float16)
    plain = np.full(context_mixing.NODES * context_mixing.STEPS, 0.5)
    named = np.zeros(context_mixing.KINDS)
    weights = rng.normal(size=context_mixing.START.shape)
    model = context_mixing.Model(table.tobytes(), weights, plain, named)
    texts = ["the cat saw the cat", "", "Zoë 12 saw the\tcat", "x" * 40 + " the cat"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    run = context_mixing._run(data, offsets)
    hashes, first = words.hashed_words(data, offsets, lower=True)
    wanted = []
    for i, text in enumerate(texts):
        cost, before = -log10(context_mixing.KINDS), context_mixing.BEGIN
        names = [*hashes[first[i] : first[i + 1]], context_mixing.END]
        for word, name in zip([*text.encode().lower().split(), b""], names, strict=True):
            cost += model.costs(
                run.text_kinds[i : i + 1], np.array([len(word)]), np.frombuffer(word, np.uint8),
                np.ones(1, np.int64), np.array([before]),
            )[0]
            before = name
        wanted.append(cost)
    assert np.allclose(model.text_costs(run), wanted, rtol=1e-5)
    text = pa.array(["often " * 1_200_000, "seldom"])
    (counted,) = context_mixing._context_counts(1)(iter([pa.RecordBatch.from_arrays([text], ["text"])]))
    found = np.frombuffer(counted.column("numbers")[0].as_py(), np.float32).reshape(-1, 2)
    lows = [*context_mixing.OFFSETS, context_mixing.SLOTS]
    bits = [found[a:b].sum(dtype=float) for a, b in zip(lows[:-1], lows[1:], strict=True)]
    assert bits == [5 * (1_200_000 * 6 + 7 + 2)] * len(bits)
