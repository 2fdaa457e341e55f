"""Mixing of sources to target weights, in fixed-length blocks.

A source's documents follow one another as one stream of words, which is cut into blocks. Each output shard draws how
many of its slots every source fills; a source's slots are numbered over all shards, and a pseudorandom permutation of
its block numbers says which block a slot takes. A source that gives more than it has starts another permutation.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.llm.common import map_batches
from cubitgrid.plans.tables import Tables

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times what it has.
MOST_TIMES = 3
BLOCK_WORDS, SHARD_SLOTS = 256, 1_024
#: The plan has a few numbers a source, which the driver and each task hold; more sources than this are refused.
MAX_SOURCES = 100_000
#: Documents whose places in a source's stream one task works out together, about.
CHUNK_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, the first one with that before it too: these add up to the text.
SPELLED = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def targets(sizes: list[int], weights: list[int], most: int = MOST_TIMES) -> list[float]:
    """Shares of the total by weight; none is above `most` times its size, and what is cut off goes to the others by weight.

    The level at which shares settle is found in order of size by weight: sources before it are full.
    """
    rest, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    full = 0
    while full < len(order) and most * sizes[i := order[full]] * weight <= weights[i] * rest:
        out[i] = float(most * sizes[i])
        rest, weight, full = rest - most * sizes[i], weight - weights[i], full + 1
    for i in order[full:]:
        out[i] = weights[i] * rest / weight
    return out


@dataclass
class Source:
    """A source's place in the plan: its stream's words, its target, and the words and slots that the mix takes of it."""

    name: str | None
    rank: int
    words: int
    target: float
    wanted: int
    slots: int


def planned(sizes: DataFrame, weights: tuple[int, ...], block: int) -> list[Source]:
    """The plan of all sources of sizes (source, words), in code point order, a null name last."""
    rows = sizes.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    n = [r.words for r in rows]
    got = targets(n, [weights[i % len(weights)] for i in range(len(rows))])
    out = []
    for rank, (r, target) in enumerate(zip(rows, got, strict=True)):
        wanted = min(int(target + 0.5), MOST_TIMES * r.words)
        whole, rest = divmod(wanted, r.words) if r.words else (0, 0)
        out.append(Source(r.source, rank, r.words, target, wanted, whole * -(-r.words // block) + -(-rest // block)))
    return out


def mixed64(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit words (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype("uint64")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """index permuted among 0..size-1 under its key, element by element: a Feistel network over the next even number of
    bits, walked until it falls below size."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size, 2).astype("float64"))).astype("int64"))
    bits = bits + (np.left_shift(np.int64(1), bits) < size)
    half = ((bits + 1) // 2).astype("uint64")
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype("uint64"), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (mixed64(right ^ mixed64(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype("uint64")]
    return out.astype("int64")


def _drawn(spark, plan: list[Source], shard_slots: int, seed: int) -> DataFrame:
    """(shard, rank, n): how many slots of each shard every source fills, a multinomial draw by the sources' slots."""
    slots = np.array([s.slots for s in plan], "int64")
    total = int(slots.sum())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shard, rank, n = [], [], []
        for at in batch.column("shard").to_pylist():
            got = np.random.default_rng([seed, at]).multinomial(min(shard_slots, total - at * shard_slots), slots / total)
            used = np.flatnonzero(got)
            shard.append(np.full(len(used), at))
            rank.append(used)
            n.append(got[used])
        return pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in (shard, rank, n)], names=["shard", "rank", "n"])

    shards = -(-total // shard_slots)
    return map_batches(spark.range(shards).withColumnRenamed("id", "shard"), run, "shard bigint, rank bigint, n bigint")


def _slots(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """(shard, rank, begin, n): runs of a source's slot numbers in a shard, so that each number from 0 to the source's
    slots is given once.

    Draws miss a source's slots by about their square root. What a source drew too often, in its last shards, is given to
    the sources that drew too seldom, one by one in order.
    """
    by_source = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.withColumn("begin", F.coalesce(F.sum("n").over(by_source), F.lit(0))).join(F.broadcast(plan.select("rank", "slots")), "rank")
    good = F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("begin")))
    runs = runs.withColumn("good", good).withColumn("more", F.col("n") - F.col("good"))
    in_order = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, *by: F.coalesce(F.sum(c).over(in_order(*by)), F.lit(0))
    count_up = lambda start, n: F.explode(F.sequence(start, start + n - 1))
    over = runs.where("more > 0").withColumn("first", before("more", "rank", "shard")).select("shard", count_up(F.col("first"), F.col("more")).alias("i"))
    drew = drawn.groupBy("rank").agg(F.sum("n").alias("drew"))
    short = plan.select("rank", "slots").join(drew, "rank", "left").withColumn("less", F.col("slots") - F.coalesce("drew", F.lit(0))).where("less > 0")
    short = short.withColumn("first", before("less", "rank")).select("rank", F.coalesce("drew", F.lit(0)).alias("drew"), "first", count_up(F.col("first"), F.col("less")).alias("i"))
    moved = over.join(short, "i").select("shard", "rank", (F.col("drew") + F.col("i") - F.col("first")).alias("begin"), F.lit(1).cast("bigint").alias("n"))
    return runs.where("good > 0").select("shard", "rank", "begin", F.col("good").alias("n")).unionByName(moved)


def _blocks(runs: DataFrame, plan: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, place, rank, block, words): the block that each slot takes, and how many of its words, counted from its start.

    A source's last block may be short; it comes last in each round, and the very last slot stops where the source has
    given what is wanted, so a source gives exactly that. `place` orders a shard's slots.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = {c: batch.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in batch.schema.names}
        of = np.repeat(np.arange(batch.num_rows), got["n"])
        shard, rank, words, wanted, slots = (got[c][of] for c in ("shard", "rank", "words", "wanted", "slots"))
        j = got["begin"][of] + np.arange(len(of)) - (np.cumsum(got["n"]) - got["n"])[of]
        full = words // block
        each = full + (words % block > 0)
        turn, at = j // each, j % each
        key = mixed64(mixed64(rank.astype("uint64") + np.uint64(seed)) ^ turn.astype("uint64"))
        number = full.copy()
        whole = at < full
        number[whole] = permuted(at[whole], full[whole], key[whole])
        taken = np.where(whole, block, words - full * block)
        taken = np.where(j == slots - 1, wanted - turn * words - at * block, taken)
        place = (mixed64(mixed64(shard.astype("uint64") ^ np.uint64(seed << 32)) ^ mixed64(rank.astype("uint64") << np.uint64(40) ^ j.astype("uint64"))) >> np.uint64(1)).astype("int64")
        return pa.record_batch([pa.array(x, pa.int64()) for x in (shard, place, rank, number, taken)], names=["shard", "place", "rank", "block", "words"])

    rows = runs.join(F.broadcast(plan.select("rank", "words", "wanted", "slots")), "rank")
    return map_batches(rows, run, "shard bigint, place bigint, rank bigint, block bigint, words bigint")


class Mix:
    """A mix of all documents of a table; `documents` has what is known of each, `slots()` what every slot takes.

    docs: any table with doc_id, source and text; null sources are a source of their own, null and empty texts have no
    words and are never taken. Rows that repeat an id are documents of their own. An empty table gives an empty mix.
    Places and draws rest on hashes of the rows alone, so runs agree.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 1, with_text: bool = False) -> None:
        self.spark, self.block, self.with_text = docs.sparkSession, block, with_text
        tables = Tables(self.spark, "mixing")
        text = F.coalesce("text", F.lit(""))
        sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"), F.xxhash64("doc_id", "text").alias("salt"), *[text.alias("text")] * with_text)
        sized = tables.cut(sized)
        self.plan = planned(sized.groupBy("source").agg(F.sum("words").alias("words")), weights, block)
        told = [(s.name, s.rank, s.words, s.target, s.wanted, s.slots) for s in self.plan]
        plan = self.spark.createDataFrame(told, "source string, rank bigint, words bigint, target double, wanted bigint, slots bigint")
        self.documents = tables.cut(self._placed(sized, plan))
        tables.drop(sized)
        drawn = tables.cut(_drawn(self.spark, self.plan, shard_slots, seed))
        self.blocks = tables.cut(_blocks(_slots(plan, drawn), plan, block, seed))
        tables.drop(drawn)

    def _placed(self, sized: DataFrame, plan: DataFrame) -> DataFrame:
        """sized with its source's figures and `start`, the words before it in its source's stream.

        A stream is summed up in chunks of rows by hash, then over chunks, so that no task takes a whole source.
        """
        some = plan.select(F.col("source").alias("of"), "rank", F.col("words").alias("source_size"), "target")
        rows = sized.join(F.broadcast(some), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        rows = rows.withColumn("chunk", F.pmod("salt", F.lit(max(1, sized.count() // CHUNK_ROWS))))
        before = lambda by, *order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chunks = rows.groupBy("rank", "chunk").agg(F.sum("words").alias("words")).select("rank", "chunk", before(["rank"], "chunk").alias("chunk_start"))
        placed = rows.withColumn("start", before(["rank", "chunk"], "salt", "doc_id", "words")).join(chunks, ["rank", "chunk"])
        return placed.withColumn("start", F.col("start") + F.col("chunk_start")).drop("chunk", "chunk_start", "salt")

    def pieces(self) -> DataFrame:
        """(rank, block, at, start, doc_id, from_word, n[, text]): which words of which document lie where in a block."""
        first, last = (F.floor(c / self.block).cast("bigint") for c in (F.col("start"), F.col("start") + F.col("words") - 1))
        spelled = F.regexp_extract_all("text", F.lit(SPELLED), F.lit(0)) if self.with_text else F.lit(None)

        def piece(b):
            begin = F.greatest(F.col("start"), b * self.block)
            n = F.least(F.col("start") + F.col("words"), (b + 1) * self.block) - begin
            word = begin - F.col("start")
            text = [F.array_join(F.slice("spelled", word.cast("int") + 1, n.cast("int")), "").alias("text")] if self.with_text else []
            return F.struct(b.alias("block"), (begin - b * self.block).alias("at"), word.alias("from_word"), n.alias("n"), *text)

        rows = self.documents.where("words > 0").withColumn("spelled", spelled)
        cut = rows.select("rank", "start", "doc_id", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
        return cut.select("rank", "start", "doc_id", "p.*")

    def slots(self) -> DataFrame:
        """(shard, place, rank, block, at, start, doc_id, from_word, n[, text]): blocks joined to slots by their numbers."""
        met = self.pieces().join(self.blocks.withColumnRenamed("words", "most"), ["rank", "block"]).where("at < most")
        kept = F.least(F.col("n"), F.col("most") - F.col("at"))
        if self.with_text:
            part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPELLED), F.lit(0)), F.lit(1), kept.cast("int")), "")
            met = met.withColumn("text", F.when(kept < F.col("n"), part).otherwise(F.col("text")))
        return met.withColumn("n", kept).drop("most")

    def texts(self) -> DataFrame:
        """(shard, place, source_rank, text): each slot's block as text, its documents' parts a line apart."""
        if not self.with_text:
            raise ValueError("a mix without texts")
        parts = self.slots().groupBy("shard", "place", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
        return parts.select("shard", "place", F.col("rank").alias("source_rank"), F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken): how many words the mix takes of each document, repeats counted."""
        sums = self.slots().groupBy("rank", "start").agg(F.sum("n").alias("taken"))
        known = lambda rows, taken: rows.select("doc_id", F.col("words").alias("size"), "source_size", "target", taken.alias("taken"))
        some = self.documents.where("words > 0").join(sums, ["rank", "start"], "left")
        return known(some, F.coalesce("taken", F.lit(0))).unionByName(known(self.documents.where("words = 0"), F.lit(0).cast("bigint")))
