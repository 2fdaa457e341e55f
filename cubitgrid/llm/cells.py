"""Pairwise work inside groups, in cells of bounded size.

A group of many rows is cut into blocks; a cell holds two blocks of a group (or one with itself), so that any
two rows of a group meet in a cell and no cell grows with its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.common import give_back


#: Groups whose rows stay where they are when sizes are joined to them, at most, and the fewest rows of such a group.
LARGE_GROUPS, LEAST_LARGE = 1_000, 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """rows with the columns of their group, inner; groups: a row for each key, with `size`, its number of rows.

    Of n rows at most LARGE_GROUPS groups can hold more than n / LARGE_GROUPS each: these groups are broadcast, and their
    rows dealt by `salt`, so that no task takes a large group.
    """
    more = [c for c in groups.columns if c != key]
    many = max(LEAST_LARGE, n // LARGE_GROUPS)
    named = lambda p, test: groups.where(test).select(F.col(key).alias(f"{p}_key_"), *[F.col(c).alias(f"{p}_{c}_") for c in more])
    large = rows.join(F.broadcast(named("large", F.col("size") > many)), F.col(key) == F.col("large_key_"), "left")
    large = large.withColumn("at_", F.when(F.col("large_key_").isNull(), F.col(key)).otherwise(F.xxhash64(salt)))
    met = large.join(named("small", F.col("size") <= many), F.col("at_") == F.col("small_key_"), "left")
    pick = [F.when(F.col("large_key_").isNotNull(), F.col(f"large_{c}_")).otherwise(F.col(f"small_{c}_")).alias(c) for c in more]
    return met.where("large_key_ is not null or small_key_ is not null").select(*rows.columns, *pick)


def with_size(rows: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """rows of groups of more than one row, with `size`: their group's number of rows, by partial sums."""
    return join_groups(rows, rows.groupBy(key).agg(F.count("*").alias("size")).where("size > 1"), key, salt, n)


def to_cells(rows: DataFrame, group: str, blocks: Column, salt: Column) -> DataFrame:
    """rows with `cell` and `own`: a row of block b of a group of n blocks goes to the n cells that block b is part
    of; own marks the cell that the block has for itself."""
    out = rows.withColumn("blocks_", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("block_", F.pmod(salt, F.col("blocks_")).cast("int"))
    out = out.withColumn("with_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    return out.withColumn("own", F.col("block_") == F.col("with_")).withColumn("cell", F.xxhash64(F.col(group), F.least("block_", "with_"), F.greatest("block_", "with_"))).drop("blocks_", "block_", "with_")


def each_cell(rows: DataFrame, work: Callable[[dict[str, np.ndarray | pa.Array]], pa.RecordBatch | None], schema: str, partitions: int | None = None) -> DataFrame:
    """work(columns of a cell's rows) for each cell; a cell's rows are contiguous in a sorted partition."""
    dealt = rows.repartition(partitions, "cell") if partitions else rows.repartition("cell")
    dealt = dealt.sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            at = 0
            if held and held[-1].column("cell")[0].as_py() != cells[0]:
                yield from done(held)
                held = []
            for cut in cuts.tolist():
                yield from done([*held, batch.slice(at, cut - at)])
                held, at = [], cut
            held.append(batch.slice(at))
        if held:
            yield from done(held)
        give_back()

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if one.num_rows > 1 and (out := work(one)) is not None and out.num_rows:
            yield out

    return dealt.mapInArrow(run, schema)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links: for each row that some link reaches, itself and the first row it is connected to."""
    n = len(linked)
    root = np.full(n, -1)
    for i in np.flatnonzero(linked.any(1)):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                new = np.flatnonzero(linked[front].any(0) & (root < 0))
                root[new] = i
                front = new
    member = np.flatnonzero((root >= 0) & (root != np.arange(n)))
    return member, root[member]
