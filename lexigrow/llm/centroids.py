"""Centroid clustering of integer vectors in JVM expressions only.

Every vector is a column of integers. Distances to the centroids of a round are
``aggregate(zip_with(v, <literal centroid>, (a, b) -> (a - b) * (a - b)), 0, +)``, one expression per
centroid; ``array_min`` over ``struct(distance, number)`` picks the nearest, ties to the smaller
number. New centroids are column sums of one grouped aggregate (partial sums per task, so a cluster
that holds a third of all rows is summed where the rows are, and the shuffle carries one row per
task and cluster). The driver receives only ``k`` rows of sums a round and sends the next centroids
back as literals, so what crosses the driver is bounded by ``k * dims`` whatever the row count.
No Python function touches a row.

Defined cases: vectors that are null, not of ``dims`` components, or hold a null or non-finite
component are not clustered and not returned. Repeated rows are clustered and returned once per
row, and weigh once per row in the sums. Rows with a null id are clustered and returned but never
seed a centroid. Seeds are the ``k`` rows of smallest lowercase-hex SHA-256 of ``<salt>:<id>``
(ties of equal hashes, that is repeated ids, by the vector); with fewer than ``k`` usable rows
there are as many centroids as rows, and none without usable rows (an empty result). A centroid
without members keeps its place. Other input columns are not carried, so their names cannot
clash. Components are floored to 64-bit integers; inputs above about 2**26 / scale in magnitude
overflow the squared distances and fail under ANSI mode rather than give wrong numbers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrow.llm.store import kept

#: Fixed parameters of the registered query.
DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SALT = "1"


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id",
                    dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(id, v)``: usable vectors with every component ``x`` as ``floor(scale * x)``, x in double."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    good = x.isNotNull() & (F.size(x) == dims) & finite
    return df.where(good).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"),
    )


def _distance(centre: list[int]) -> Column:
    literal = F.lit(centre).cast("array<bigint>")
    squares = F.zip_with("v", literal, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda acc, e: acc + e)


def nearest(centres: list[list[int]]) -> Column:
    """``struct(distance, cluster)`` of the nearest centroid, ties to the smaller number."""
    return F.array_min(F.array(*[
        F.struct(_distance(c).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centres)
    ]))


def seeds(vectors: DataFrame, k: int, salt: str = SALT) -> list[list[int]]:
    """The first ``k`` vectors by SHA-256 of ``<salt>:<id>``: a top-k of each task, then of those."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).orderBy(digest, "v").limit(k).select("v").collect()
    return [list(r["v"]) for r in rows]


def update(assigned: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid as the exact componentwise floor of its members' mean."""
    dims = len(centres[0])
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    ).collect()
    after = [list(c) for c in centres]
    for row in sums:
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return after


def digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(str(x) for x in centre).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS,
            salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """Lloyd rounds over ``(id, v)``; the final assignment and the final centroids.

    Columns: id, v, cluster int, distance long, cluster_inertia long, inertia long,
    centroid_sha256 string.
    """
    vectors = kept(vectors.select("id", "v"), "centroids")
    centres = seeds(vectors, k, salt)
    if not centres:
        empty = vectors.where(F.lit(False))
        return empty.select(
            "id", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"),
            F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"),
            F.lit(None).cast("string").alias("centroid_sha256"),
        ), []
    for _ in range(rounds):
        assigned = vectors.select("v", nearest(centres)["cluster"].alias("cluster"))
        centres = update(assigned, centres)
    best = nearest(centres)
    final = vectors.select("id", "v", best["cluster"].alias("cluster"), best["distance"].alias("distance"))
    per = {r["cluster"]: r["d"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    inertia = [int(per.get(j) or 0) for j in range(len(centres))]
    at = F.col("cluster") + 1
    return final.select(
        "id", "v", "cluster", "distance",
        F.element_at(F.lit(inertia).cast("array<bigint>"), at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        F.element_at(F.lit([digest(c) for c in centres]), at).alias("centroid_sha256"),
    ), centres
