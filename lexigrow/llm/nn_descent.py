"""Links between embeddings of one label, by NN-descent.

Equal vectors are one class. Every class keeps a list of its nearest neighbours down to ``FLOOR``
below the threshold. Lists start from random cells, by signs of random projections. The deeper
the cells of a label, the more trees of cells it has, so that a pair at the threshold misses all
cells with a probability of at most ``MISS`` at any size. Lists are refined by rounds
of the neighbours-of-neighbours join: two neighbours of one class that are in different
components are compared, and rounds go on until no link is new. An audit compares samples of all
classes and of those with links with all of their label. Links it finds missing are added, with
more cells and a new sample, until it finds none.

A list that is full of links is saturated: it may leave out others, even all links to another
tight group. Components therefore do not rest on lists: within a cell all pairs are compared, and
besides the lists as many links leave it as connect what is linked there. At the end whole
components are compared block by block, which yields the exact number of links of each class
without a row for each pair.
Cells and components larger than ``BLOCK`` are dealt out by hash, so no task holds a large group;
then all pairs of their blocks are compared, of cells only where components differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrow.llm.blocks import block_pairs
from lexigrow.llm.store import kept, measured, parts
from lexigrow.llm.vectors import matrix, packed, unpacked, usable
from lexigrow.llm.words import tidy
from lexigrow.operators.components import components

#: Length of a list, how far below the threshold it goes, classes of a cell, of a block.
LIST, FLOOR, CELL, BLOCK = 16, 0.15, 128, 1024
#: Probability that a pair at the threshold shares no cell; audited classes of each sample.
MISS, AUDIT = 5e-6, 200


def cell_plan(threshold: float, bits: int = 40) -> list[tuple[int, int]]:
    """Depth and number of trees, for each largest depth from 0 to ``bits``.

    Two vectors at the threshold are on one side of a random plane with probability
    ``1 - angle / pi``. Depths that cost more comparisons in their many trees than they
    save are passed over.
    """
    same = 1 - np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi
    plan, least = [], np.inf
    for depth in range(bits + 1):
        meets = same**depth
        trees = 1.0 if meets == 1 else np.ceil(np.log(MISS) / np.log1p(-meets)) if meets > 1e-12 else np.inf
        if trees / 2.0**depth < least:
            least, best = trees / 2.0**depth, (depth, int(trees))
        plan.append(best)
    return plan


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the usable rows."""
    for batch in batches:
        _, by_size = usable(batch.column(2))
        for length, rows in by_size.items():
            values = matrix(batch.column(2), rows)
            # Scaled first, so that squares of very large or small components stay finite.
            values = values / np.abs(values).max(axis=1, keepdims=True)
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pick),
                    pa.array([f"{x}/{length}" for x in batch.column(1).take(pick).to_pylist()]),
                    packed(values / np.sqrt((values * values).sum(axis=1, keepdims=True))),
                ],
                names=["id", "kind", "vector"],
            )


def _cells(first: int, times: int):
    """A row for each tree and class: its cell, named by label, tree and projection signs. Of the
    ``trees`` of a label, trees from ``first`` times that number to below ``times`` times it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            length = np.array([len(v.as_buffer()) for v in batch.column(1)])
            for size in np.unique(length):
                rows = pa.array(np.flatnonzero(length == size))
                vectors = batch.column(1).take(rows)
                values = unpacked(vectors)
                kinds, ids = batch.column(3).take(rows), batch.column(0).take(rows)
                bits = np.asarray(batch.column(2).take(rows)).astype(np.int64)
                count = np.asarray(batch.column(4).take(rows)).astype(np.int64)
                for tree in range(first * int(count.min()), times * int(count.max())):
                    pick = np.flatnonzero((tree >= first * count) & (tree < times * count))
                    if not len(pick):
                        continue
                    planes = np.random.default_rng((tree, int(size))).normal(size=(values.shape[1], 40))
                    signs = (values[pick] @ planes > 0).astype(np.int64) @ (1 << np.arange(40))
                    some = pa.array(pick)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(some),
                            kinds.take(some),
                            pa.array(np.full(len(pick), tree, dtype=np.int32)),
                            pa.array(signs & ((1 << bits[pick]) - 1)),
                            vectors.take(some),
                        ],
                        names=["id", "kind", "tree", "signs", "vector"],
                    )

    return run


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of as few links as connect what a symmetric matrix of links connects."""
    left = linked.any(axis=1)
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in np.flatnonzero(left):
        front = np.array([start]) if left[start] else np.empty(0, np.int64)
        left[start] = False
        while len(front):
            reach = linked[front] & left
            new = np.flatnonzero(reach.any(axis=0))
            i.append(front[reach[:, new].argmax(axis=0)])
            j.append(new)
            left[new] = False
            front = new
    return np.concatenate(i), np.concatenate(j)


def _lists(floor: float, threshold: float):
    """The nearest neighbours of each class within one cell, down to the floor, and links that
    connect all that is linked in the cell."""

    def run(rows: pa.Table) -> pa.Table:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())])
        ids, values = np.asarray(rows.column("id")), unpacked(rows.column("vector"))
        linked = np.zeros((len(ids), len(ids)), bool)
        u, v, cos = [], [], []
        for low in range(0, len(ids), BLOCK):
            near = values[low : low + BLOCK] @ values.T
            near[np.arange(len(near)), np.arange(low, low + len(near))] = -2.0
            linked[low : low + BLOCK] = near >= threshold
            if near.shape[1] > LIST:
                bar = np.partition(near, -LIST, axis=1)[:, -LIST]
                near[near < bar[:, None]] = -2.0
            i, j = np.nonzero(near >= floor)
            u.append(np.minimum(ids[low + i], ids[j]))
            v.append(np.maximum(ids[low + i], ids[j]))
            cos.append(near[i, j])
        i, j = spanning(linked | linked.T)
        u.append(np.minimum(ids[i], ids[j]))
        v.append(np.maximum(ids[i], ids[j]))
        # Rounding must not take a link below the threshold.
        cos.append(np.maximum((values[i] * values[j]).sum(axis=1), threshold))
        return pa.table([pa.array(np.concatenate(x)) for x in (u, v, cos)], schema=schema)

    return run


def _cosines(floor: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cos = (unpacked(batch.column(2)) * unpacked(batch.column(3))).sum(axis=1)
            pick = pa.array(cos >= floor)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pick), batch.column(1).filter(pick), pa.array(cos).filter(pick)],
                names=["u", "v", "cos"],
            )

    return run


def _across(threshold: float):
    """Links between components, as few as connect what is linked, within a block or between
    two blocks of one cell."""

    def run(rows: pa.Table) -> pa.Table:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())])
        root, side = np.asarray(rows.column("root")), np.asarray(rows.column("side"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right) or (root == root[0]).all():
            return schema.empty_table()
        ids, values = np.asarray(rows.column("id")), unpacked(rows.column("vector"))
        linked = np.zeros((len(ids), len(ids)), bool)
        near = values[left] @ values[right].T >= threshold
        linked[np.ix_(left, right)] = near & (root[left][:, None] != root[right])
        i, j = spanning(linked | linked.T)
        cos = np.maximum((values[i] * values[j]).sum(axis=1), threshold)
        u, v = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return pa.table([pa.array(u), pa.array(v), pa.array(cos)], schema=schema)

    return run


def _cell_lists(
    classes: DataFrame, first: int, times: int, floor: float, threshold: float, links: DataFrame | None = None
) -> DataFrame:
    """Lists from cells. ``links`` are those known already."""
    rows = kept(
        classes.select("id", "vector", "bits", "kind", "trees").mapInArrow(
            _cells(first, times), "id long, kind string, tree int, signs long, vector binary"
        )
    )
    cell = ["kind", "tree", "signs"]
    large = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    large = measured(large.where(F.col("rows") > BLOCK))
    split = F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK)
    dealt = rows.join(large, cell, "left").withColumn(
        "salt", F.pmod(F.xxhash64("id", "tree"), split)
    )
    found = dealt.groupBy(*cell, "salt").applyInArrow(
        _lists(floor, threshold), "u long, v long, cos double"
    )
    lists = kept(found.groupBy("u", "v").agg(F.max("cos").alias("cos")))
    if not large.limit(1).count():
        return lists
    # Members of a large cell met only those dealt to the same part of it.
    known = lists.where(F.col("cos") >= threshold).select("u", "v")
    roots = components(known if links is None else known.union(links.select("u", "v")))
    roots = roots.select(F.col("node").alias("id"), "root")
    placed = rows.select(*cell, "id").join(large.select(*cell), cell).join(roots, "id", "left")
    placed = kept(placed.select(*cell, "id", F.coalesce("root", "id").alias("root")))
    pairs = block_pairs(placed, cell, BLOCK).join(classes.select("id", "vector"), "id")
    across = kept(
        pairs.groupBy(*cell, "i", "j").applyInArrow(_across(threshold), "u long, v long, cos double")
    )
    return kept(lists.union(across).groupBy("u", "v").agg(F.max("cos").alias("cos")))


def _joined(lists: DataFrame, roots: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """New pairs from the neighbours-of-neighbours join, between different components."""
    root = roots.select(F.col("node").alias("id"), "root")
    both = lists.select(F.col("u").alias("mid"), F.col("v").alias("id")).union(
        lists.select(F.col("v").alias("mid"), F.col("u").alias("id"))
    )
    near = kept(
        both.join(root, "id", "left").select("mid", "id", F.coalesce("root", "id").alias("root"))
    )
    mixed = near.groupBy("mid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    near = near.join(measured(mixed.where("low < high").select("mid")), "mid", "left_semi")
    other = near.select("mid", F.col("id").alias("v"), F.col("root").alias("other"))
    pairs = (
        near.withColumnRenamed("id", "u")
        .join(other, "mid")
        .where(F.col("root") < F.col("other"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
        .join(lists, ["u", "v"], "left_anti")
    )
    vectors = classes.select("id", "vector")
    full = pairs.join(vectors.toDF("u", "left_vector"), "u").join(vectors.toDF("v", "right_vector"), "v")
    return kept(
        full.select("u", "v", "left_vector", "right_vector").mapInArrow(
            _cosines(floor), "u long, v long, cos double"
        )
    )


def _audited(asked: pa.Table, threshold: float):
    """Links of the audited classes to other components."""
    ids, roots = np.asarray(asked.column("id")), np.asarray(asked.column("root"))
    kinds = np.array(asked.column("kind").to_pylist())
    values = [np.frombuffer(v, np.float64) for v in asked.column("vector").to_pylist()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, kind = np.asarray(batch.column(0)), np.array(batch.column(1).to_pylist())
            root = np.asarray(batch.column(3))
            for k in np.unique(kinds):
                rows, of = np.flatnonzero(kind == k), np.flatnonzero(kinds == k)
                if not len(rows):
                    continue
                near = np.stack([values[i] for i in of]) @ unpacked(
                    batch.column(2).take(pa.array(rows))
                ).T
                i, j = np.nonzero((near >= threshold) & (roots[of][:, None] != root[rows]))
                a, b = ids[of[i]], own[rows[j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(a, b)),
                        pa.array(np.maximum(a, b)),
                        pa.array(near[i, j]),
                    ],
                    names=["u", "v", "cos"],
                )

    return run


def missed_links(classes: DataFrame, roots: DataFrame, threshold: float, turn: int = 0) -> DataFrame:
    """Links ``(u, v, cos)`` between different components, of ``AUDIT`` classes sampled from all
    and as many from those with links, found by comparing with all of their label. Every
    ``turn`` has samples of its own."""
    placed = kept(
        classes.select("id", "kind", "vector")
        .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .select("id", "kind", "vector", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked"))
    )
    order = [F.xxhash64("id", F.lit(turn)), F.col("id")]
    some = placed.orderBy(*order).limit(AUDIT)
    asked = some.union(placed.where("linked").orderBy(*order).limit(AUDIT)).distinct().toArrow()
    schema = "u long, v long, cos double"
    found = placed.drop("linked").mapInArrow(_audited(asked, threshold), schema)
    return kept(found.groupBy("u", "v").agg(F.max("cos").alias("cos")))


def _counted(threshold: float):
    """Links of the classes of components (or of two blocks of one), by matrix products."""

    def run(rows: pa.Table) -> pa.Table:
        root, side = np.asarray(rows.column("root")), np.asarray(rows.column("side"))
        ids, weight = np.asarray(rows.column("id")), np.asarray(rows.column("weight"))
        blobs = rows.column("vector").to_pylist()
        order = np.argsort(root, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(root[order]) != 0, [True])))
        out_ids, out_links = [], []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            pick = order[low:high]
            left, right = pick[side[pick] != 1], pick[side[pick] != 0]
            a = np.frombuffer(b"".join(blobs[i] for i in left), np.float64).reshape(len(left), -1)
            b = np.frombuffer(b"".join(blobs[i] for i in right), np.float64).reshape(len(right), -1)
            if not len(left) or not len(right):
                continue
            for k in range(0, len(left), BLOCK):
                rows_at = left[k : k + BLOCK]
                linked = (a[k : k + BLOCK] @ b.T >= threshold) & (ids[rows_at][:, None] != ids[right])
                out_ids.append(ids[rows_at])
                out_links.append(linked @ weight[right])
                if side[rows_at[0]] == 0:  # two blocks: the other one counts as well
                    out_ids.append(ids[right])
                    out_links.append(weight[rows_at] @ linked)
        if not out_ids:
            return pa.table([pa.array([], pa.int64())] * 2, names=["id", "links"])
        return pa.table(
            [pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_links).astype(np.int64))],
            names=["id", "links"],
        )

    return run


def link_counts(classes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """``(id, links)`` of the classes in components, counting copies: exact, block by block."""
    spark = classes.sparkSession
    placed = kept(
        classes.join(roots.select(F.col("node").alias("id"), "root"), "id").select(
            "id", "root", "weight", "vector"
        )
    )
    size = placed.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    large = measured(size.where(F.col("size") > BLOCK))
    small = placed.join(large, "root", "left_anti").select(
        F.pmod(F.xxhash64("root"), F.lit(4 * parts(spark))).alias("group"),
        F.lit(0).alias("i"),
        F.lit(0).alias("j"),
        F.lit(2).alias("side"),  # both sides
        "id", "root", "weight", "vector",
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = placed.join(large, "root").select(
        "id", "root", "weight", "vector", blocks.alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"),
    )
    grid = dealt.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    ).select(
        F.col("root").alias("group"),
        (F.least("own", "with") + 1).alias("i"),
        (F.greatest("own", "with") + 1).alias("j"),
        F.when(F.col("own") == F.col("with"), 2)
        .when(F.col("own") < F.col("with"), 0)
        .otherwise(1)
        .alias("side"),
        "id", "root", "weight", "vector",
    )
    counted = small.union(grid).groupBy("group", "i", "j").applyInArrow(
        _counted(threshold), "id long, links long"
    )
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def embedding_links(
    table: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(id, n_links, component_id)``: one row for each row of ``table`` with an id.

    Two rows are linked if their labels are equal and not null and the cosine of their vectors,
    in double precision, is at least ``threshold``. ``n_links`` counts the other rows linked
    with a row, ``component_id`` is the smallest id reachable over links, itself included.
    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. Rows that repeat an id are rows of their own that share a
    component. Rows without an id are not returned; other columns are ignored.
    """
    rows = table.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("vector"),
    )
    units = kept(
        rows.where("label is not null").mapInArrow(tidy(_units), "id long, kind string, vector binary")
    )
    # Copies are one class, named by its smallest id.
    classes = units.groupBy("kind", "vector").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")
    )
    classes = kept(classes)
    kinds = classes.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
    most = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("rows") / CELL)))).cast("int")
    bits, trees = (F.array(*map(F.lit, x)) for x in zip(*cell_plan(threshold), strict=True))
    kinds = kinds.select(
        "kind", F.get(bits, most).alias("bits"), F.get(trees, most).alias("trees")
    )
    classes = kept(classes.join(measured(kinds), "kind"))
    floor = threshold - FLOOR
    lists = _cell_lists(classes, 0, 1, floor, threshold)
    times = 1
    while True:
        links = lists.where(F.col("cos") >= threshold)
        roots = kept(components(links.select("u", "v")))
        more = _joined(lists, roots, classes, floor)
        if more.where(F.col("cos") >= threshold).limit(1).count():
            lists = kept(lists.union(more))
            continue
        missed = missed_links(classes, roots, threshold, times)
        if not missed.limit(1).count():
            break
        # Every turn joins components, so turns come to an end.
        added = _cell_lists(classes, times, times + 1, floor, threshold, links.union(missed))
        every = lists.union(missed).union(added)
        lists = kept(every.groupBy("u", "v").agg(F.max("cos").alias("cos")))
        times += 1
    counts = link_counts(classes, roots, threshold)
    known = (
        classes.select("kind", "vector", F.col("id").alias("class"), "weight")
        .join(counts.withColumnRenamed("id", "class"), "class", "left")
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    )
    known = kept(
        known.select(
            "kind", "vector", "class", "weight",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "class").alias("component_id"),
        )
    )
    # Most classes are one row, which is found by its id alone.
    single = known.where("weight = 1").select(
        F.col("class").alias("id"), "kind", "n_links", "component_id"
    )
    copied = measured(known.where("weight > 1").drop("class", "weight"))
    several = units.join(copied, ["kind", "vector"]).select("id", "kind", "n_links", "component_id")
    found = single.union(several)
    return _every_row(rows, found)


def _every_row(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All rows with an id: the found ones, and the others with no link."""
    named = found.groupBy("id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    return rows.select("id").join(named, "id", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
