"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from lexigrow.session import settled


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edge table ``(u, v)``; the root is the smallest
    node of its component. Nodes may be of any orderable type.

    Batches of edges between plain nodes are first thinned to forests where they lie. Each round then links a
    node's neighbours to its smallest neighbour, first the larger ones, then the smaller ones,
    until every edge points from a node to its root. A node of many neighbours costs a partial
    minimum, not a list, and nothing but a row count and a checksum reaches the driver.
    """
    thin = edges.select("u", "v")
    if isinstance(edges.schema["u"].dataType, (IntegralType, StringType)):
        kind = edges.schema["u"].dataType.simpleString()
        thin = thin.mapInPandas(_forests, f"u {kind}, v {kind}")
    current = settled(thin.distinct())
    nodes = current.select(F.col("u").alias("node")).union(
        current.select(F.col("v").alias("node"))
    )
    current = current.where(F.col("u") != F.col("v"))
    before = _state(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # Neighbours above u go to the smallest of u's neighbourhood.
        large = both.where(F.col("v") > F.col("u")).join(low, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now every edge points down; u and its lower neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        current = settled(small.where(F.col("u") != F.col("v")).distinct())
        # Settled when a round changes no edge.
        after = _state(current)
        if before == after:
            break
        before = after
    found = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return (
        nodes.distinct()
        .join(found, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"))
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
    ).first()
    return row["n"], row["sum"]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each batch of edges, one edge from every node to the smallest node it reaches."""
    for batch in batches:
        parent: dict = {}

        def find(node, parent=parent):
            while parent[node] != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(node, find(node)) for node in parent]
        yield pd.DataFrame(rows, columns=["u", "v"]).astype(batch.dtypes.to_dict())
