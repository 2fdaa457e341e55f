"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors, then exact cosines."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.cells import each_cell, forest, join_groups, to_cells, with_size
from cubitgrid.llm.common import map_batches
from cubitgrid.llm.minhash import mix
from cubitgrid.operators.components import components
from cubitgrid.plans.shipping import ship
from cubitgrid.plans.tables import Tables

COSINE = 0.93
#: Chance that a pair at the threshold shares no key.
MISS = 1e-6
#: Rotations whose codes a vector keeps for estimates, and the half width of the bounds in standard deviations.
CODES = 4
WIDTH = 5.0
BLOCK_ROWS = 384


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Bits of a key and number of keys: a random pair of `rows` vectors shares a given key about once, and a pair
    at the threshold misses all keys with a chance of MISS."""
    bits = min(32, max(8, ceil(log2(max(rows, 2)))))
    agree = 1 - np.arccos(cosine) / np.pi
    return bits, ceil(log(MISS) / log(1 - agree**bits))


@lru_cache(maxsize=8)
def rotations(size: int, count: int) -> np.ndarray:
    """`count` fixed random orthogonal matrices of this size, stacked."""
    rng = np.random.default_rng(size * 1_000_003)
    return np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(count)])


def unit(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors, all of one length, scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "float64").reshape(batch.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 64)))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (sign bits of each rotation), correction factors (a vector's product with its code) and 8-bit vectors."""
    x = padded(x)
    size = x.shape[1]
    y = (x @ rotations(size, CODES).T).reshape(len(x), CODES, size)
    return np.packbits(y.reshape(len(x), -1) > 0, axis=1), (np.abs(y).sum(2) / np.sqrt(size)).astype("float32"), np.round(x * 127).astype("int8")


def possible(codes: np.ndarray, factors: np.ndarray, coarse: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows may have this cosine: the estimate's upper confidence bound reaches it.

    A code times its correction factor is an unbiased estimate of a vector's products with any other; its
    deviation falls with the vector's product with its own code and with the square root of the dimension.
    """
    n, size = coarse.shape
    signs = np.unpackbits(codes, axis=1).reshape(n, CODES, size).astype("float64") * 2 - 1
    back = sum((signs[:, r] / np.sqrt(size) / factors[:, r, None]) @ rotations(size, CODES)[r * size : (r + 1) * size] for r in range(CODES)) / CODES
    estimate = back @ (coarse.astype("float64") / 127).T
    deviation = np.sqrt(((1 - factors.astype("float64") ** 2) / factors.astype("float64") ** 2).sum(1)) / CODES / np.sqrt(size - 1)
    bound = WIDTH * deviation * np.sqrt(1 - cosine**2) + 0.5 / 127 * np.sqrt(size) * 0.6
    upper = estimate + bound[:, None]
    out = (upper >= cosine) & (upper.T >= cosine)
    np.fill_diagonal(out, False)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; only vectors of one label are compared.

    1. Equal vectors of a label are one class, with its number of members.
    2. Bits of rotated vectors make keys; classes that share a key meet in cells. Codes decide there whether a
       pair can reach the threshold; pairs that can span candidate groups.
    3. The vectors of a candidate group meet in cells. Codes bound each cosine there too: those of pairs that may reach
       the threshold are computed again in double precision, counted for both vectors and spanned. Pairs are never
       written out and no cell grows with its group.
    A pair at the threshold is missed with a chance of about 1e-6; links that are found are exact.

    Null, zero and empty vectors, such with null or non-finite components, and null labels link with nothing;
    vectors of different length don't either. Rows that repeat an id are one vector and have one row; where their
    vectors or labels differ, one that can link counts before one that can't, and of those the one with the smaller
    hash. Each row without an id is a vector of its own. component_id is the smallest id of the group; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    tables = Tables(spark, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), vec.alias("v"))
    rows = rows.select("vec_id", "label", "v", F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumns({"hi": F.xxhash64("label", "v"), "lo": F.xxhash64(F.lit(1), "v", "label")})
    # one row for each vector, by its hashes alone; vectors themselves are shuffled once, one for each class
    said = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct((~F.col("good")).alias("bad"), "hi", "lo")).alias("r")).select("vec_id", "r.hi", "r.lo", (~F.col("r.bad")).alias("good"))
    ids = tables.cut(said.unionByName(rows.where("vec_id is null").select("vec_id", "hi", "lo", "good")))
    members = ids.where("good").groupBy("hi", "lo").agg(F.count("*").alias("members"), F.min(F.coalesce("vec_id", F.xxhash64("hi", "lo"))).alias("node"), F.min("vec_id").alias("least_id"))
    one = rows.where("good").groupBy("hi", "lo").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    grouped = one.join(members, ["hi", "lo"]).withColumn("kind", F.xxhash64("label", F.size("v")))

    def to_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [np.array(v, "float64").tobytes() for v in batch.column("v").to_pylist()]
        return pa.record_batch([batch.column(c) for c in ("hi", "lo", "members", "node", "least_id", "kind")] + [pa.array(raw, pa.binary())], names=["hi", "lo", "members", "node", "least_id", "kind", "vector"])

    classes = tables.cut(map_batches(grouped.select("hi", "lo", "members", "node", "least_id", "kind", "v"), to_bytes, "hi bigint, lo bigint, members bigint, node bigint, least_id bigint, kind bigint, vector binary"))
    largest = classes.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    bits, n_keys = plan(largest, cosine)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sizes = np.array([len(v) for v in batch.column("vector").to_pylist()])
        parts = []
        for size in np.unique(sizes):
            some = batch.filter(pa.array(sizes == size))
            x = padded(unit(some))
            turns = rotations(x.shape[1], CODES + ceil(bits * n_keys / x.shape[1]))[CODES * x.shape[1] :][: bits * n_keys]
            ink = ((x @ turns.T) > 0).reshape(len(x), n_keys, bits)
            keys = (ink.astype("uint64") << np.arange(bits, dtype="uint64")).sum(2, dtype="uint64")
            kind = some.column("kind").to_numpy().astype("int64").view("uint64")
            keys = mix(mix(kind)[:, None] ^ mix((np.arange(n_keys, dtype="uint64") << np.uint64(32))[None, :] ^ keys)).view("int64")
            codes, factors, coarse = encode(unit(some))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * n_keys + 1, n_keys), pa.int32()), pa.array(keys.ravel()))
            cols = [some.column("node"), flat, *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, factors, coarse)]]
            parts.append(pa.record_batch(cols, names=["node", "keys", "codes", "factors", "coarse"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    sketched = tables.cut(map_batches(classes.select("node", "kind", "vector"), sketch, "node bigint, keys array<bigint>, codes binary, factors binary, coarse binary"))
    n_classes = sketched.count()
    shared = with_size(sketched.select("node", F.explode("keys").alias("key")), "key", "node", n_keys * n_classes)
    met = shared.join(sketched.select("node", "codes", "factors", "coarse"), "node")
    met = to_cells(met, "key", F.ceil(F.col("size") / BLOCK_ROWS), F.xxhash64("node", F.lit(1))).select("cell", "node", "codes", "factors", "coarse")

    def open_pairs(batch: pa.RecordBatch) -> np.ndarray:
        read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)
        return possible(read("codes", "uint8"), read("factors", "float32"), read("coarse", "int8"), cosine)

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        member, root = forest(open_pairs(batch))
        node = batch.column("node").to_numpy()
        return pa.record_batch([pa.array(node[member]), pa.array(node[root])], names=["a", "b"])

    groups = tables.cut(components(each_cell(met, candidates, "a bigint, b bigint"), tables))
    full = join_groups(groups, groups.groupBy("root").agg(F.count("*").alias("size")), "root", "node", n_classes).join(classes.select("node", "members", "vector"), "node").join(sketched.select("node", "codes", "factors", "coarse"), "node")
    half, blocks = F.xxhash64("node", F.lit(2)), F.ceil(F.col("size") / BLOCK_ROWS)
    full = full.withColumn("block", F.pmod(half, blocks.cast("int")).cast("int"))
    cells = to_cells(full, "root", blocks, half).select("cell", "own", "node", "block", "members", "vector", "codes", "factors", "coarse")

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(batch)
        block, members = batch.column("block").to_numpy(), batch.column("members").to_numpy()
        linked = open_pairs(batch)
        some = np.flatnonzero(linked.any(1))
        linked[np.ix_(some, some)] &= x[some] @ x[some].T >= cosine
        if not batch.column("own")[0].as_py():  # pairs inside a block are counted in the cell that it has for itself
            linked &= block[:, None] != block[None, :]
        node = batch.column("node").to_numpy()
        member, root = forest(linked)
        to = node.copy()
        to[member] = node[root]
        return pa.record_batch([pa.array(node), pa.array(to), pa.array(linked.astype("int64") @ members)], names=["a", "b", "links"])

    found = tables.cut(each_cell(cells, exact, "a bigint, b bigint, links bigint"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    final = components(found.select("a", "b"), tables)
    named = classes.join(final, "node", "left").join(links, "node", "left").select("node", "hi", "lo", "members", "least_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = named.groupBy("root").agg(F.count("*").alias("size"), F.min("least_id").alias("component_id"))
    named = join_groups(named, least, "root", "node", n_classes).select("hi", "lo", (F.col("links") + F.col("members") - 1).alias("n_links"), "component_id", F.lit(True).alias("good"))
    out = ids.join(named, ["hi", "lo", "good"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
