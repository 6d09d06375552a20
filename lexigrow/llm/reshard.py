"""Resharding by minimum-cost flow: even shards with the fewest bytes moved.

The files of a table are the old shards. A new shard has an equal share of all bytes as its
capacity; keeping a byte in the shard of its file's number costs nothing, moving it costs one.
Files beyond the number of shards have no place of their own, so all of their bytes move and
they are one supply. All moves cost the same wherever they go, so they pass one hub, and the
network has a few nodes for each new shard however many files there are.

Bytes move in blocks, which are runs of neighbouring rows of about a 64th of a capacity. A file
keeps its largest blocks as far as its flow goes; the others go, largest first, to the shard
with the most room left. The driver sees a row for each file and block: at most 128 blocks for
each new shard and two for each file. Texts are not shuffled: every task writes its rows to the
folders of their new shards, and shards that nothing enters or leaves are not rewritten.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrow.llm.store import kept, measured
from lexigrow.session import scratch_path

#: Blocks of a new shard, about, and rows that get their slots together.
BLOCKS, RUN_ROWS = 64, 50_000


class Network:
    """A flow network with whole capacities and costs."""

    def __init__(self) -> None:
        self.edges: list[list[int]] = []  # head, room, cost; the reverse edge follows
        self.at: dict[object, list[int]] = defaultdict(list)
        self.names: dict[object, int] = {}

    def connect(self, tail, head, room: int, cost: int) -> int:
        number = len(self.edges)
        self.edges += [[head, room, cost], [tail, 0, -cost]]
        self.at[tail].append(number)
        self.at[head].append(number + 1)
        return number

    def flow(self, number: int) -> int:
        return self.edges[number ^ 1][1]

    def cheapest(self, source, sink) -> int:
        """Sends as much as possible at the least cost, path by path; the cost."""
        potential: dict = defaultdict(int)
        total = 0
        while True:
            order = {node: k for k, node in enumerate(self.at)}
            distance = {source: 0}
            via: dict = {}
            heap = [(0, order[source], source)]
            while heap:
                length, _, node = heapq.heappop(heap)
                if length > distance[node]:
                    continue
                for number in self.at[node]:
                    head, room, cost = self.edges[number]
                    reduced = length + cost + potential[node] - potential[head]
                    if room > 0 and reduced < distance.get(head, reduced + 1):
                        distance[head] = reduced
                        via[head] = number
                        heapq.heappush(heap, (reduced, order[head], head))
            if sink not in distance:
                return total
            for node, length in distance.items():
                potential[node] += length
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.edges[via[node] ^ 1][0]
            amount = min(self.edges[number][1] for number in path)
            for number in path:
                self.edges[number][1] -= amount
                self.edges[number ^ 1][1] += amount
                total += amount * self.edges[number][2]


def capacities(total: int, shards: int) -> list[int]:
    """Shares of ``total`` that differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def stays(sizes: list[int], shards: int) -> tuple[list[int], int]:
    """For old shards of these sizes, the bytes that each of the first ``shards`` keeps, and
    the bytes that have to move at least."""
    room = capacities(sum(sizes), shards)
    net = Network()
    stay = []
    for k in range(shards):
        size = sizes[k] if k < len(sizes) else 0
        net.connect("source", ("old", k), size, 0)
        stay.append(net.connect(("old", k), ("new", k), size, 0))
        net.connect(("old", k), "hub", size, 1)
        net.connect("hub", ("new", k), room[k], 0)
        net.connect(("new", k), "sink", room[k], 0)
    rest = sum(sizes[shards:])
    net.connect("source", "others", rest, 0)
    net.connect("others", "hub", rest, 1)
    cost = net.cheapest("source", "sink")
    return [net.flow(number) for number in stay], cost


def transfers(blocks: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """The new shard of each block ``(old shard, block, bytes)``."""
    sizes: dict[int, int] = defaultdict(int)
    for old, _, size in blocks:
        sizes[old] += size
    ordered = [sizes[k] for k in range(max(sizes, default=-1) + 1)]
    keep, _ = stays(ordered, shards)
    room = capacities(sum(ordered), shards)
    target, moving = {}, []
    for old, block, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        if old < shards and size <= keep[old]:
            keep[old] -= size
            room[old] -= size
            target[old, block] = old
        else:
            moving.append((old, block, size))
    heap = [(-left, k) for k, left in enumerate(room)]
    heapq.heapify(heap)
    for old, block, size in moving:
        left, k = heapq.heappop(heap)
        target[old, block] = k
        heapq.heappush(heap, (left + size, k))
    return target


def plan(docs: DataFrame, shards: int, text_col: str = "text") -> DataFrame:
    """``docs`` (read from Parquet files) with ``__size``, ``__shard``, ``__slot`` and
    ``__moved``: whether anything enters or leaves the shard."""
    spark = docs.sparkSession
    rows = docs.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("__size"),
    )
    files = rows.groupBy("__file").agg(
        F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    found = sorted((r["__file"], r["bytes"], r["rows"]) for r in files.collect())
    total = sum(f[1] for f in found)
    step = max(1, total // (shards * BLOCKS))
    # Rows of a block: as many as hold about a step of bytes in that file.
    listed = [
        (name, k, max(1, count * step // max(1, size))) for k, (name, size, count) in enumerate(found)
    ]
    known = spark.createDataFrame(listed, "__file string, __old int, __rows long")
    rows = rows.join(measured(known), "__file").withColumn(
        "__block", F.floor(F.col("__row") / F.col("__rows"))
    )
    run = F.floor(F.col("__row") / RUN_ROWS)
    runs = kept(
        rows.groupBy("__old", "__block", run.alias("__run")).agg(
            F.sum("__size").alias("bytes"),
            F.count(F.lit(1)).alias("rows"),
            F.min("__row").alias("__first"),
        )
    )
    blocks = runs.groupBy("__old", "__block").agg(F.sum("bytes").alias("bytes")).collect()
    target = transfers([(r["__old"], r["__block"], r["bytes"]) for r in blocks], shards)
    moved = {k for (old, _), k in target.items() if k != old}
    moved |= {old for (old, _), k in target.items() if k != old}
    dealt = spark.createDataFrame(
        [(old, block, k, k in moved) for (old, block), k in sorted(target.items())],
        "__old int, __block long, __shard int, __moved boolean",
    )
    over = Window.partitionBy("__shard").orderBy("__old", "__first")
    slots = runs.join(measured(dealt), ["__old", "__block"]).select(
        "__old",
        "__block",
        "__run",
        "__shard",
        "__moved",
        "__first",
        (F.sum("rows").over(over) - F.col("rows")).alias("__base"),
    )
    placed = rows.withColumn("__run", run).join(measured(slots), ["__old", "__block", "__run"])
    return placed.select(
        *docs.columns,
        "__size",
        "__shard",
        (F.col("__base") + F.col("__row") - F.col("__first")).alias("__slot"),
        "__moved",
    )


def reshard(
    docs: DataFrame, shards: int = 24, text_col: str = "text", folder: str | None = None
) -> tuple[DataFrame, str]:
    """Deals the rows of a table to ``shards`` shards of about equal bytes.

    Returns the rows with ``__size`` (UTF-8 bytes of the text plus 8, null as 0 plus 8),
    ``__shard`` and ``__slot`` (their place in the shard, from 0 on, without gaps), and the
    folder with the rewritten shards (``__shard=<k>``). ``docs`` has to be read whole from
    Parquet files; order within a shard is that of files and rows. Rows that repeat count each,
    other columns go along, and columns that start with two underscores are reserved.
    """
    spark: SparkSession = docs.sparkSession
    placed = plan(docs, shards, text_col)
    folder = folder or scratch_path(spark, "shards")
    placed.where("__moved").drop("__moved").write.partitionBy("__shard").parquet(folder)
    schema = placed.drop("__moved").schema
    back = spark.read.schema(schema).parquet(folder)
    still = placed.where("not __moved").drop("__moved")
    return back.select(*still.columns).union(still), folder
