"""Near duplicates by an LSH forest over min-hash signatures, confirmed on full sets.

A document's set holds its distinct shingles of consecutive words. Documents of equal sets are
one class from the start. Every class has a signature of ``BINS`` one-permutation min-hashes.
A tree of the forest is the list of all classes sorted by another order of the signature; the
sort runs as a range partition, so a region of very many similar signatures spreads over as
many tasks as it needs. Two classes are candidates

1. as neighbours in the first ``LINKING`` sorted lists that share the base prefix: neighbours
   have the longest common prefix there is, so the depth adapts to how dense a region is;
2. after those are confirmed and linked up, as members of one region of any tree that still
   belong to different components and whose sketches agree as far as chance lets similar sets
   differ (five standard deviations). A region is a base prefix at any size; more than
   ``REGION`` classes are compared as pairs of blocks. The number of candidates is not capped,
   but pairs that an earlier link connects are skipped, and only links leave a region.

Candidates are confirmed on whole sets of 64-bit shingle names. Two sets of exactly the
threshold 0.8 share no base prefix in any tree with a probability of 2 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrow.llm.blocks import block_pairs
from lexigrow.llm.store import kept, measured, parts, small_batches
from lexigrow.llm.words import U, hashed_words, mix, text_slices, tidy
from lexigrow.operators.components import components

BINS = 256
#: Cells of the sketch that bins are made of.
CELL_BITS = 10
CELLS = 1 << CELL_BITS
#: Signature bins of the base prefix, trees, and trees whose neighbours are compared first.
DEPTH, TREES, LINKING = 6, 36, 3
#: Classes of a region that are compared as one block.
REGION = 1024
_rng = np.random.default_rng(20240501)
#: For every tree, the bins of its base prefix and the eight that refine the order.
ORDERS = np.stack([_rng.permutation(BINS)[: DEPTH + 8] for _ in range(TREES)])
#: Bins to borrow from where a bin is empty, attempt by attempt.
BORROW = np.stack([_rng.permutation(BINS) for _ in range(64)])
#: For each bin that is still empty then, the rank of every bin to borrow from.
RANK = np.stack([_rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


def shingle_names(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct names of the shingles of one document's word hashes.

    A document of fewer words than ``size`` has its whole sequence as one shingle.
    """
    n = len(words)
    if not n:
        return words
    wide = min(size, n)
    name = np.full(n - wide + 1, U(wide), dtype=U)
    for k in range(wide):
        name *= U(0x9E3779B97F4A7C15)
        name += words[k : n - wide + 1 + k]
        name ^= name >> U(29)
    name = mix(name)
    name.sort()
    return name[np.concatenate(([True], name[1:] != name[:-1]))]


def batch_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle names of each text of a column."""
    for _, _, data, offsets in text_slices(column):
        words, first = hashed_words(data, offsets, lower=True)
        for i in range(len(first) - 1):
            yield shingle_names(words[first[i] : first[i + 1]], size)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``CELLS`` bytes for each non-empty sorted set: a mark of the least name in
    each cell of the range of names, 0 for an empty cell."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)) * CELLS, size)
    cell += (every >> U(64 - CELL_BITS)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    out = np.zeros(len(sets) * CELLS, dtype=np.uint8)
    out[cell[lead]] = (mix(every[lead]) % U(255)).astype(np.uint8) + np.uint8(1)
    return out.reshape(-1, CELLS)


def signatures(marks: np.ndarray) -> np.ndarray:
    """Min-hash signatures of ``BINS`` bytes from sketches. A bin takes its first full cell;
    an empty bin borrows from another one."""
    folded = marks.reshape(len(marks), BINS, CELLS // BINS)
    first = (folded > 0).argmax(axis=2)
    out = np.take_along_axis(folded, first[:, :, None], axis=2)[:, :, 0]
    own, full = out.copy(), out > 0
    row, col = np.nonzero(~full)
    for attempt in BORROW:
        if not len(row):
            break
        source = attempt[col]
        ok = full[row, source]
        out[row[ok], col[ok]] = own[row[ok], source[ok]] + (col[ok] % 7).astype(np.uint8)
        row, col = row[~ok], col[~ok]
    # With too few shingles for the attempts, every bin has its own order of the full ones, so
    # that bins agree independently of each other.
    for k in range(0, len(row), 1 << 14):
        r, c = row[k : k + (1 << 14)], col[k : k + (1 << 14)]
        source = np.where(full[r], RANK[c], np.int16(BINS)).argmin(axis=1)
        out[r, c] = own[r, source] + (c % 7).astype(np.uint8)
    return out


def _summaries(size: int):
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("h1", pa.int64()),
            ("h2", pa.int64()),
            ("sketch", pa.binary()),
        ]
    )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, len(ids), 1000):
                sets = list(batch_sets(texts.slice(low, 1000), size))
                count = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(count)
                marks: list[bytes | None] = [None] * len(sets)
                h1, h2 = np.zeros((2, len(sets)), dtype=np.int64)
                if len(some):
                    full = [sets[i] for i in some]
                    for i, row in zip(some, sketches(full), strict=True):
                        marks[i] = row.tobytes()
                    h1[some] = [s.sum().astype(np.int64) for s in full]
                    h2[some] = [mix(s ^ U(0x5851F42D4C957F2D)).sum().astype(np.int64) for s in full]
                part = ids.slice(low, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(count), pa.array(h1), pa.array(h2), pa.array(marks, pa.binary())],
                    schema=schema,
                )

    return run, "id long, n_shingles long, h1 long, h2 long, sketch binary"


@tidy
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every tree and class: region (tree and base prefix), refinement, id."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        ids = np.asarray(batch.column(0))
        marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, CELLS)
        marks = np.concatenate([signatures(marks[k : k + 500]) for k in range(0, n, 500)])
        region = np.empty((TREES, n), dtype=np.int64)
        rest = np.empty((TREES, n), dtype=np.int64)
        for tree, order in enumerate(ORDERS):
            picked = marks[:, order].astype(np.int64)
            key = np.full(n, tree, dtype=np.int64)
            for k in range(DEPTH):
                key = (key << 8) | picked[:, k]
            region[tree] = key
            key = picked[:, DEPTH] - 128
            for k in range(DEPTH + 1, DEPTH + 8):
                key = (key << 8) | picked[:, k]
            rest[tree] = key
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.ravel()), pa.array(rest.ravel()), pa.array(np.tile(ids, TREES))],
            names=["region", "rest", "id"],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by region, rest, id: members of regions with others, and, in the
    first trees, the neighbour before each. The ends of a partition count as shared."""
    schema = pa.schema([(n, pa.int64()) for n in ("region", "rest", "id", "before")])
    held = None  # the last row so far: whether its region goes on is not known yet
    for batch in batches:
        if not len(batch):
            continue
        region, rest, ids = (np.asarray(batch.column(k)) for k in range(3))
        opened, prior = True, -1
        if held is not None:
            region, rest, ids = (
                np.concatenate(([old], new))
                for old, new in zip(held[:3], (region, rest, ids), strict=True)
            )
            opened, prior = held[3:]
        same = region[1:] == region[:-1]
        shared = np.concatenate(([opened], same))
        linked = same & ((region[1:] >> (8 * DEPTH)) < LINKING) & (ids[1:] != ids[:-1])
        before = np.concatenate(([prior], np.where(linked, ids[:-1], -1)))
        held = (region[-1], rest[-1], ids[-1], bool(shared[-1]), before[-1])
        shared[:-1] |= same
        pick = shared[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(region[:-1][pick]),
                pa.array(rest[:-1][pick]),
                pa.array(ids[:-1][pick]),
                pa.array(before[:-1][pick], mask=before[:-1][pick] < 0),
            ],
            schema=schema,
        )
    if held is not None:
        last = [pa.array([int(x)]) for x in held[:3]]
        before = None if held[4] < 0 else int(held[4])
        yield pa.RecordBatch.from_arrays([*last, pa.array([before], pa.int64())], schema=schema)


def _links_within(threshold_percent: int):
    """Links between members of different components within a block of a region, or between two
    blocks of one, as few as connect what is linked there.

    Sketches rule out pairs that are surely not similar; the others are compared on their full
    sets. Cells are a sample without replacement of the union of two sets, so the error of the
    estimate shrinks to nothing as the cells take in the whole union.
    """

    def run(rows: pa.Table) -> pa.Table:
        root = np.asarray(rows.column("root"))
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        if (root == root[0]).all():
            return schema.empty_table()
        ids, root = np.asarray(rows.column("id")), root.copy()
        side = np.asarray(rows.column("side"))
        right = np.flatnonzero(side == 1)
        sets = [np.frombuffer(x, U) for x in rows.column("names").to_pylist()]
        sizes, marks = np.array([len(s) for s in sets]), sketches(sets)
        full = (marks > 0).sum(axis=1)
        share = threshold_percent / 100
        u, v = [], []
        for i in np.flatnonzero(side != 1):
            others = right if side[i] == 0 else np.arange(i + 1, len(ids))
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            open_to = others[(root[others] != root[i]) & (low >= share * high)]
            if not len(open_to):
                continue
            cells = np.flatnonzero(marks[i])
            other = marks[np.ix_(open_to, cells)]
            common = (other == marks[i][cells]).sum(axis=1)
            seen = full[i] + full[open_to] - (other > 0).sum(axis=1)
            # A union of similar sets is at most so large, and at least as large as what is seen.
            union = np.maximum((sizes[i] + sizes[open_to]) / (1 + share), seen)
            error = 5 * np.sqrt(share * (1 - share) / seen * (1 - seen / union)) + 2 / seen + 0.01
            near = np.flatnonzero(common >= (share - error) * seen)
            for j in open_to[near[np.argsort(-common[near] / seen[near], kind="stable")]].tolist():
                if root[j] != root[i] and _similar(sets[i], sets[j], threshold_percent):
                    u.append(min(ids[i], ids[j]))
                    v.append(max(ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def _similar(x: np.ndarray, y: np.ndarray, threshold_percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    low, high = sorted((len(x), len(y)))
    if 100 * low < threshold_percent * high:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold_percent * (low + high - common)


def _sets(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(batch), 500):
                rows = [s.tobytes() for s in batch_sets(texts.slice(low, 500), size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, 500), pa.array(rows, pa.binary())],
                    names=["id", "names"],
                )

    return run


def _alike(threshold_percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            keep = [
                _similar(np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U), threshold_percent)
                for a, b in both
            ]
            pick = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pick), batch.column(1).filter(pick)], names=["u", "v"]
            )

    return run


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(id, names)``: the sets of the documents whose ids are given. ``docs``: id, text."""
    some = docs.join(measured(ids.distinct()), "id", "left_semi").dropDuplicates(["id"])
    return kept(some.mapInArrow(_sets(size), "id long, names binary"))


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, threshold_percent: int) -> DataFrame:
    """Those pairs ``(u, v)`` of ids whose full sets are similar enough. ``docs``: id, text.

    Only documents in pairs are turned into sets, and a set moves once for each of its pairs.
    """
    pairs = kept(pairs)
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id")))
    sets = full_sets(docs, wanted, size)
    left = sets.select(F.col("id").alias("u"), F.col("names").alias("left_names"))
    right = sets.select(F.col("id").alias("v"), F.col("names").alias("right_names"))
    joined = pairs.join(left, "u").join(right, "v")
    return joined.select("u", "v", "left_names", "right_names").mapInArrow(
        _alike(threshold_percent), "u long, v long"
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    threshold_percent: int = 80,
) -> DataFrame:
    """``(id, n_shingles, component_id)``: one row for each row of ``docs`` with an id.

    ``component_id`` is the smallest id reachable over links; two documents are linked if
    100 * intersection >= ``threshold_percent`` * union of their shingle sets. Texts that are
    null, empty or white space have no shingles and are linked with nothing. Rows of one id
    are one document. Rows without an id take no part and are not returned. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("id").isNotNull())
    run, schema = _summaries(shingle_words)
    found = kept(texts.mapInArrow(run, schema))
    key = ["n_shingles", "h1", "h2"]
    some = found.where("n_shingles > 0")
    classes = some.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copies = measured(classes.where("first < last").drop("last"))
    members = found.join(copies, key, "left").select(
        "id", "n_shingles", F.coalesce("first", "id").alias("class"), "sketch"
    )
    members = kept(
        members.withColumn("sketch", F.when(F.col("class") == F.col("id"), F.col("sketch")))
    )
    singles = members.where("sketch is not null").select("id", "sketch")
    forest = kept(singles.mapInArrow(_forest, "region long, rest long, id long"))
    regions = kept(
        forest.repartitionByRange(parts(spark), "region", "rest", "id")
        .sortWithinPartitions("region", "rest", "id")
        .mapInArrow(_neighbours, "region long, rest long, id long, before long")
    )
    first = regions.where("before is not null").select(
        F.least("id", "before").alias("u"), F.greatest("id", "before").alias("v")
    )
    links = kept(confirmed(texts, first.distinct(), shingle_words, threshold_percent))
    roots = measured(components(links))
    placed = regions.select("region", "id").join(
        roots.select(F.col("node").alias("id"), "root"), "id", "left"
    )
    placed = kept(placed.select("region", "id", F.coalesce("root", "id").alias("root")))
    open_rows = kept(block_pairs(placed, ["region"], REGION))
    more = kept(
        open_rows.join(full_sets(texts, open_rows.select("id"), shingle_words), "id")
        .groupBy("region", "i", "j")
        .applyInArrow(_links_within(threshold_percent), "u long, v long")
    )
    copy_links = members.where("class <> id").select(F.col("id").alias("u"), F.col("class").alias("v"))
    # Rows of one id may differ in text; the links of all of them count.
    joined = components(links.union(more).union(copy_links.distinct()))
    roots = joined.select(F.col("node").alias("id"), "root")
    return members.join(roots, "id", "left").select(
        "id", "n_shingles", F.coalesce("root", "id").alias("component_id")
    )
