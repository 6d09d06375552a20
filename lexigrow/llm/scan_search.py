"""Nearest neighbours by inner product: inverted lists with an adaptive scan of dimensions.

Largest inner product is made least distance: every vector gets one more component that brings
all of them to the same norm, and queries get 0 there. The extended vectors are rotated at
random, so that the first ``d`` of ``D`` components are a fair sample of a distance. A probed
list is scanned in column blocks. After each block the hypothesis that a candidate is as near as
the query's current k-th is tested: if its partial distance, scaled by ``D / d``, exceeds
the k-th by more than the factor ``(1 + DOUBT / sqrt(d)) ** 2``, it is given up. What remains is
measured on the original vectors in double precision.

Lists come from k-means on at most ``FIT_ROWS`` vectors. How many lists a query probes is found
by exact search for ``AUDIT`` queries over all rows, so that the lists of their true neighbours
are reached. A list and its queries are dealt out in parts of at most ``PART`` rows each, so a
list with a third of all vectors, or one that all queries probe, is many small groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrow.llm.store import kept, measured
from lexigrow.llm.vectors import matrix, packed, unpacked, usable
from lexigrow.llm.words import tidy

#: Vectors for k-means, queries of the audit, most lists, and the aim of the audit.
FIT_ROWS, AUDIT, MOST_LISTS, AIM = 20_000, 200, 1024, 0.985
#: Rows of a part; columns of a block; doubt of the test.
PART, COLUMNS, DOUBT = 4096, 16, 2.1


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as packed doubles, with length and squared norm."""
    for batch in batches:
        _, by_size = usable(batch.column(1))
        for length, rows in by_size.items():
            values = matrix(batch.column(1), rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.full(len(rows), length)),
                    pa.array((values * values).sum(axis=1)),
                    packed(values),
                    batch.column(2).take(pa.array(rows)),
                ],
                names=["id", "length", "norm", "vector", "query"],
            )


def centres(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k-means centres of a sample."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), size=min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = _distances(sample, found).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(found))
        for k in np.flatnonzero(size):
            found[k] = sample[nearest == k].mean(axis=0)
    return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)


def _extended(values: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest - (values * values).sum(axis=1), 0.0))
    return np.concatenate([values, rest[:, None]], axis=1)


def _asked(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values, np.zeros((len(values), 1))], axis=1)


def _exact(queries: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest of a partition for each audited query."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, values = np.asarray(batch.column(0)), unpacked(batch.column(1))
            score = queries @ values.T
            score[ids[:, None] == own] = -np.inf
            top = min(k, len(own))
            pick = np.argpartition(-score, top - 1, axis=1)[:, :top]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(ids)), top)),
                    pa.array(np.take_along_axis(score, pick, 1).ravel()),
                    packed(values[pick.ravel()]),
                ],
                names=["query", "score", "vector"],
            )

    return run


def _probes(vectors: DataFrame, lists: np.ndarray, largest: float, k: int) -> int:
    """How many lists reach the share ``AIM`` of true neighbours of audited queries."""
    asked = vectors.where("query").orderBy(F.xxhash64("id"), "id").limit(AUDIT).toArrow()
    if not len(asked) or len(lists) == 1:
        return len(lists)
    queries, ids = unpacked(asked.column("vector")), np.asarray(asked.column("id"))
    found = vectors.select("id", "vector").mapInArrow(
        _exact(queries, ids, k), "query long, score double, vector binary"
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    best = found.withColumn("place", place).where(F.col("place") <= k).toArrow()
    if not len(best):
        return len(lists)
    true = _extended(unpacked(best.column("vector")), largest)
    order = _distances(_asked(queries), lists).argsort(axis=1)
    rank = order.argsort(axis=1)
    owner = _distances(true, lists).argmin(axis=1)
    needed = rank[np.asarray(best.column("query")), owner]
    return int(np.quantile(needed, AIM, method="higher")) + 1


def _listed(lists: np.ndarray, largest: float, probes: int):
    """A row for each vector with its list, and one for each list that a query probes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "asks", "id", "vector"]
        for batch in batches:
            if not len(batch):
                continue
            ids, values = np.asarray(batch.column(0)), unpacked(batch.column(1))
            own = _distances(_extended(values, largest), lists).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(np.zeros(len(ids), bool)), pa.array(ids), batch.column(1)],
                names=names,
            )
            rows = np.flatnonzero(np.asarray(batch.column(2)))
            if len(rows):
                away = _distances(_asked(values[rows]), lists)
                near = np.argsort(away, axis=1, kind="stable")[:, :probes]
                again = np.repeat(rows, near.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(near.ravel()),
                        pa.array(np.ones(len(again), bool)),
                        pa.array(ids[again]),
                        batch.column(1).take(pa.array(again)),
                    ],
                    names=names,
                )

    return run


def scan(
    query: np.ndarray,
    own: np.ndarray,
    rotated_query: np.ndarray,
    rotated: np.ndarray,
    values: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of a list that are nearest to a query, and their inner products. ``own``
    marks the query's own row."""
    width = rotated.shape[1]
    live = np.flatnonzero(~own)
    first = live[: 4 * k]
    if len(live) > len(first):
        # The first candidates are measured whole; their k-th distance is the bar.
        gap = rotated[first] - rotated_query
        bar = np.partition((gap * gap).sum(axis=1), k - 1)[k - 1]
        rest = live[len(first) :]
        partial = np.zeros(len(rest))
        for low in range(0, width, COLUMNS):
            high = min(width, low + COLUMNS)
            gap = rotated[rest, low:high] - rotated_query[low:high]
            partial += (gap * gap).sum(axis=1)
            doubt = (1 + DOUBT / np.sqrt(high)) ** 2 if high < width else 1.0 + 1e-9
            near = partial * (width / high) <= bar * doubt
            rest, partial = rest[near], partial[near]
        live = np.concatenate((first, rest))
    score = values[live] @ query
    return live, score


def _searched(k: int, largest: float, rotation: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks")
        left, right = rows.filter(pc.invert(asks)), rows.filter(asks)
        schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, values = np.asarray(left.column("id")), unpacked(left.column("vector"))
        asking, queries = np.asarray(right.column("id")), unpacked(right.column("vector"))
        rotated = _extended(values, largest) @ rotation
        rotated_queries = _asked(queries) @ rotation
        out = []
        for i in range(len(asking)):
            rows, score = scan(queries[i], ids == asking[i], rotated_queries[i], rotated, values, k)
            if len(rows) > k:
                # All rows at the k-th score stay, so that ties go by id.
                rows, score = rows[pick := score >= np.partition(score, -k)[-k]], score[pick]
            out.append((np.full(len(rows), asking[i]), ids[rows], score))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(x) for x in parts], schema=schema)

    return run


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows of largest inner product with each query,
    nearest first, ties by smaller id; all rows, if fewer are there.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without an id, and vectors are compared with those of the same length only. A row of
    the query's own id is no candidate; rows that repeat another id are candidates each. Other
    columns are ignored.
    """
    spark = table.sparkSession
    rows = table.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    vectors = kept(
        rows.mapInArrow(
            _checked, "id long, length long, norm double, vector binary, query boolean"
        )
    )
    lengths = [
        (r["length"], r["rows"], r["largest"])
        for r in vectors.groupBy("length")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("largest"))
        .collect()
    ]
    results = [
        _nearest_of_length(vectors.where(F.col("length") == length), n, largest, k)
        for length, n, largest in lengths
    ]
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return (
        found.withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", "id", "score")
    )


def _nearest_of_length(vectors: DataFrame, n: int, largest: float, k: int) -> DataFrame:
    share = min(1.0, FIT_ROWS / n)
    spot = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int((1 << 30) * share)
    sample = vectors.where(spot).select("vector").toArrow()
    count = int(np.clip(np.sqrt(n) / 8, 1, MOST_LISTS)) if n >= 4 * k * 16 else 1
    fit = _extended(unpacked(sample.column("vector")), largest) if len(sample) else None
    lists = centres(fit, count) if fit is not None and count > 1 else np.zeros((1, 1))
    if len(lists) == 1:
        width = unpacked(vectors.limit(1).toArrow().column("vector")).shape[1]
        lists = np.zeros((1, width + 1))
    probes = _probes(vectors, lists, largest, k)
    rng = np.random.default_rng(1)
    rotation = np.linalg.qr(rng.normal(size=(lists.shape[1], lists.shape[1])))[0]
    listed = kept(
        vectors.select("id", "vector", "query").mapInArrow(
            _listed(lists, largest, probes), "list long, asks boolean, id long, vector binary"
        )
    )
    counts = listed.groupBy("list").agg(
        F.ceil(F.count(F.when(~F.col("asks"), 1)) / PART).alias("parts"),
        F.ceil(F.count(F.when(F.col("asks"), 1)) / PART).alias("query_parts"),
    )
    dealt = listed.join(measured(counts.where("parts > 0 and query_parts > 0")), "list")
    part = F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int")
    query_part = F.pmod(F.xxhash64("id", "vector"), F.col("query_parts")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    one = lambda c: F.array(c)
    key = ["list", "part", "query_part"]
    # A vector meets every part of the list's queries, a query every part of the list.
    return (
        dealt.withColumn("part", F.explode(F.when(F.col("asks"), every("parts")).otherwise(one(part))))
        .withColumn(
            "query_part",
            F.explode(F.when(F.col("asks"), one(query_part)).otherwise(every("query_parts"))),
        )
        .select(*key, "asks", "id", "vector")
        .groupBy(*key)
        .applyInArrow(_searched(k, largest, rotation), "query long, id long, score double")
    )
