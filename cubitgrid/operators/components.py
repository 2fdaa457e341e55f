"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.plans.shipping import ship
from cubitgrid.plans.tables import Tables

#: Edges that a task holds at a time while it shortens paths.
CHUNK = 200_000
#: Nodes whose edges stay where they are, at most, and the fewest edges of such a node.
HUBS, LEAST_HUB = 1_000, 256


def shortened(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: of each chunk of a partition, its nodes with their smallest one.

    Where neighbouring edges share a partition, most paths are gone before the first shuffle.
    """

    def forest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield forest(held)
                held, n = [], 0
        if held:
            yield forest(held)

    ship(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _signature(edges: DataFrame) -> tuple:
    """Two sets of edges are the same if their numbers, sums and differences of hashes are."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def _hooked(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) with m of least (u, m, n) at u = a.

    A node with more than `many` edges is broadcast with its m, so that its edges stay where they are: of n edges no
    more than HUBS nodes can have so many. The rest are joined by a shuffle, in which no node has more than `many`.
    """
    many = max(LEAST_HUB, n // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > many).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    rows = edges.join(hubs, F.col("a") == F.col("hub"), "left")
    # a hub's edges are dealt by their other end; what they meet there doesn't matter
    at = rows.withColumn("at", F.when(F.col("hub").isNull(), F.col("a")).otherwise(F.col("b")))
    met = at.join(least.where(F.col("n") <= many).select("u", "m"), F.col("at") == F.col("u"), "left")
    return met.select("a", "b", F.coalesce("hub_m", "m").alias("m"))


def components(edges: DataFrame, tables: Tables, most_rounds: int = 60, in_task: int = 0) -> DataFrame:
    """(node, root) of every node of edges (a, b) with another end: root is the smallest node that it reaches.

    In turn, larger neighbours and smaller neighbours of each node are hooked to its smallest one, until nothing
    changes: rounds grow with the logarithm of the longest path. Smallest neighbours are pre-aggregated and joined
    back without dealing a node's many edges to one task. Each round is a table that replaces its lineage. A graph of
    at most in_task edges after paths are shortened, CHUNK at most, is finished in one task, with the same result.
    """
    now = tables.cut(shortened(edges).distinct())
    before = _signature(now)
    if before[0] <= min(in_task, CHUNK):
        now, most_rounds = shortened(now.coalesce(1)), 0
    for _ in range(most_rounds):
        # larger neighbours of a node go to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        large = tables.cut(_hooked(both.where("b > a"), least, 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), "m", "n")
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = tables.cut(_hooked(large, least, 2 * before[0]).select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct())
        after = _signature(small)
        tables.drop(now, large)
        now = small
        if after == before:
            break
        before = after
    else:
        if most_rounds:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
