"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.llm.cells import each_cell, forest, join_groups, to_cells, with_size
from cubitgrid.llm.common import held, map_batches, texts
from cubitgrid.operators.components import components
from cubitgrid.plans.shipping import ship
from cubitgrid.plans.tables import Tables

SHINGLE = 5
#: A pair of similarity 0.75 shares no band with a chance of (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
PERCENT = 75
#: Shares of equal coordinates from which a pair is verified: 0.75 less 4.4 standard deviations.
LEAST_ESTIMATE = 0.58
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20
EDGE = "a bigint, b bigint"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_U = np.uint64


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, int, int, np.ndarray]:
    """Fixed random numbers: a value for each byte, an odd base and its inverse, odd weights of a shingle's words."""
    rng = np.random.default_rng(20_240_601)
    base = int(rng.integers(1 << 62)) | 1
    return rng.integers(0, 1 << 63, 256, dtype="uint64") * _U(2) + _U(1), base, pow(base, -1, 1 << 64), rng.integers(0, 1 << 63, 8, dtype="uint64") * _U(2) + _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, n or more, of the base and of its inverse."""
    def make() -> list[np.ndarray]:
        _, base, inverse, _ = _constants()
        return [np.multiply.accumulate(np.r_[np.ones(1, "uint64"), np.full(size - 1, b, "uint64")]) for b in (base, inverse)]

    size = 1 << max(20, n.bit_length())
    return held(("powers", size), make)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in order, and the number of words of each text.

    A word's hash is its polynomial over the whole buffer, taken from running sums and moved to the word's start.
    """
    values, _, _, _ = _constants()
    raw = b" ".join([*data, b""]).translate(_LOWER)
    buf = np.frombuffer(raw, "uint8")
    ink = ~_BLANK[buf]
    edge = np.flatnonzero(np.diff(np.r_[False, ink, False].astype("int8")))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, "uint64")
    np.cumsum(values[buf] * up[: len(buf)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype("uint64"))
    borders = np.cumsum([len(d) + 1 for d in data])
    return h, np.diff(np.r_[0, np.searchsorted(start, borders)])


def shingle_sets(docs: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = word_hashes([t.encode() for t in docs])
    weights = _constants()[3]
    n = len(h)
    if n >= SHINGLE:
        s = sum((h[k : n - SHINGLE + 1 + k] * weights[k] for k in range(SHINGLE)), start=np.zeros(n - SHINGLE + 1, "uint64"))
        s = mix(s)
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(s[at : at + c - SHINGLE + 1]))
        elif c:
            out.append(mix((h[at : at + c] * weights[:c]).sum(keepdims=True, dtype="uint64") + _U(c)))
        else:
            out.append(np.zeros(0, "uint64"))
        at += c
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """BINS coordinates for each non-empty set.

    In each of the first BINS rounds every element falls into one hashed bin of its set, and the smallest hash
    fills a bin that no earlier round has filled; in the next BINS rounds all elements compete for one bin, so
    every bin is filled. Two sets agree in a coordinate with the chance of their similarity, and the number of
    agreements is concentrated as if elements were drawn without replacement.
    """
    none = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * BINS, none)
    open_ = np.array([len(s) > 0 for s in sets])
    for i in range(2 * BINS):
        own = np.flatnonzero(open_)
        if not len(own):
            break
        if i == 0 or len(own) < last:
            x = np.concatenate([sets[k] for k in own])
            of = np.repeat(own * BINS, [len(sets[k]) for k in own])
            last = len(own)
        v = mix(x ^ _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = of + ((v >> _U(57)).astype("int64") if i < BINS else i - BINS)
        free = out[at] == none
        np.minimum.at(out, at[free], v[free] & _U((1 << 57) - 1))
        open_[own] = (out.reshape(-1, BINS)[own] == none).any(1)
    return out.reshape(-1, BINS)


def _nodes(docs: DataFrame) -> DataFrame:
    """(node, doc_id, text): a row's node is its id, or a hash of its text where it has none."""
    key = F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(key, F.xxhash64(F.lit("no id"), F.coalesce("text", F.lit("")))).alias("node"), key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _sketch_rows(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n, hi, lo, bands, coordinates) of each row of docs (node, doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch.column("text")))
        sk = sketches(sets)
        bands = np.zeros((len(sets), BANDS), "uint64")
        for k in range(BANDS):
            band = np.full(len(sets), (k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, "uint64")
            for r in range(ROWS):
                band = mix(band ^ sk[:, k * ROWS + r])
            bands[:, k] = band
        digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digest], "uint64").view("int64")
        high = np.array([d >> 64 for d in digest], "uint64").view("int64")
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view("int64").ravel()))
        short = (sk & _U(255)).astype("uint8")
        return pa.record_batch([batch.column("node"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(low), keys, pa.array([r.tobytes() for r in short], pa.binary())], names=["node", "doc_id", "n", "hi", "lo", "bands", "coordinates"])

    return map_batches(docs, run, "node bigint, doc_id bigint, n bigint, hi bigint, lo bigint, bands array<bigint>, coordinates binary")


def _alike(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of a cell's rows (node, coordinates): edges that span those whose sketches are alike."""
    node = batch.column("node").to_numpy()
    c = np.frombuffer(b"".join(batch.column("coordinates").to_pylist()), "uint8").reshape(-1, BINS)
    if len(c) == 2:
        return pa.record_batch([pa.array(node[:1]), pa.array(node[1:])], names=["a", "b"]) if (c[0] == c[1]).mean() >= LEAST_ESTIMATE else None
    linked = np.zeros((len(c), len(c)), bool)
    for i in range(len(c) - 1):
        linked[i, i + 1 :] = (c[i] == c[i + 1 :]).mean(1) >= LEAST_ESTIMATE
    member, root = forest(linked | linked.T)
    return pa.record_batch([pa.array(node[member]), pa.array(node[root])], names=["a", "b"])


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of a cell's rows (node, shingles): edges that span those whose full sets are similar enough."""
    node = batch.column("node").to_numpy()
    sets = [np.frombuffer(b, "uint64") for b in batch.column("shingles").to_pylist()]
    size = np.array(list(map(len, sets)))
    shingle, counts = np.unique(np.concatenate(sets), return_counts=True)
    of = np.repeat(np.arange(len(sets)), size)
    column = np.searchsorted(shingle, np.concatenate(sets))
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], rank[column[keep]]
    both = np.zeros((len(sets), len(sets)), "float32")
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    step = max(64, (8 << 20) // max(1, len(sets)))
    for at in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), "float32")
        m[of[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    both = both.astype("int64")
    linked = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    member, root = forest(linked)
    return pa.record_batch([pa.array(node[member]), pa.array(node[root])], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at a similarity of 0.75 or more, and their groups.

    1. Each text gives its set of shingles, a digest of the whole set and a sketch. Rows with equal sets are one
       class, so that copies cost one row each from here on.
    2. Classes that share a band meet in cells; those whose sketches are alike span candidate groups.
    3. The full sets of each candidate group meet in cells, which verify pairs exactly and span the links. In a group
       of several blocks, all are compared with one member first: those it is linked with need no more comparisons
       among themselves, and only members within a distance (1 - similarity, a metric) of 0.5 of it can be linked with
       any of them.
    Pairs are never written out, and no cell grows with its group. Links of similarity 0.75 are missed with a
    chance of about 1e-5 (no band in common, or an unlucky estimate); links found are exact.

    A null text is empty; a text without words is linked with nothing. Each input row has a row; rows that repeat
    an id are one document. component_id is the smallest doc_id of the group, null if it has only rows without
    one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark, "minhash")
    sk = tables.cut(_sketch_rows(_nodes(docs)))
    classes = tables.cut(sk.where("n > 0").groupBy("hi", "lo", "n").agg(F.min(F.struct("node", "bands", "coordinates")).alias("first"), F.min("doc_id").alias("least_id")).select("hi", "lo", "n", "first.*", "least_id"))
    n_classes = classes.count()
    keys = classes.select("node", F.explode("bands").alias("key"))
    met = with_size(keys, "key", "node", BANDS * n_classes).join(classes.select("node", "coordinates"), "node")
    met = to_cells(met, "key", F.ceil(F.col("size") / BLOCK_ROWS), F.xxhash64("node", F.lit(1))).select("cell", "node", "coordinates")
    groups = tables.cut(components(each_cell(met, _alike, EDGE), tables))
    final = components(_verified(docs, classes, n_classes, groups, tables), tables)
    named = classes.join(final, "node", "left").select("node", "hi", "lo", "n", F.coalesce("root", "node").alias("root"), "least_id")
    # the smallest doc_id of each group, joined back on its root
    least = named.groupBy("root").agg(F.count("*").alias("size"), F.min("least_id").alias("component_id"))
    named = join_groups(named, least, "root", "node", n_classes).select("hi", "lo", "n", "component_id")
    out = sk.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _to_first(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of a cell's rows (node, group, first, shingles): how similar all are to the group's first member.

    Where that id has several texts, the one with the smallest set of bytes is meant, in all cells of the group.
    """
    raw = batch.column("shingles").to_pylist()
    first = min(np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)), key=lambda k: raw[k])
    sets = [np.frombuffer(b, "uint64") for b in raw]
    one = sets[first]
    both = np.array([int((one[np.minimum(np.searchsorted(one, s), len(one) - 1)] == s).sum()) for s in sets])
    either = np.array(list(map(len, sets))) + len(one) - both
    others = np.arange(len(sets)) != first
    out = [batch.column(c).filter(pa.array(others)) for c in ("node", "group")]
    return pa.record_batch([*out, pa.array((100 * both >= PERCENT * either)[others]), pa.array((2 * both >= either)[others])], names=["node", "group", "linked", "near"])


def _verified(docs: DataFrame, classes: DataFrame, n: int, groups: DataFrame, tables: Tables) -> DataFrame:
    """Edges between the classes whose full sets are linked, looked for inside candidate groups."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch.column("text")))
        kept = [c for c in batch.schema.names if c != "text"]
        out = pa.record_batch([*[batch.column(c) for c in kept], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "shingles"])
        return out.filter(pa.array([len(s) > 0 for s in sets]))  # an id may have an empty text beside another

    n_blocks = lambda rows, size: F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")
    sized = groups.join(classes.select("node", (F.col("n") * 8).alias("bytes")), "node")
    sizes = sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("all_bytes"))
    of = join_groups(sized, sizes.select("root", "size", n_blocks("size", "all_bytes").alias("blocks")), "root", "node", n).select("node", F.col("root").alias("group"), "blocks", "bytes")
    rows = tables.cut(_nodes(docs).select("node", "text").join(of, "node"))
    salt = F.xxhash64("node", F.lit(2))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c).cast("bigint") - 1))
    few = map_batches(rows.where("blocks <= 2").select("node", "group", "blocks", "text"), run, "node bigint, group bigint, blocks int, shingles binary")
    edges = each_cell(to_cells(few, "group", F.col("blocks"), salt).select("cell", "node", "shingles"), _linked, EDGE)
    many = rows.where("blocks > 2")
    # the group's first member goes to each of its blocks
    dealt = many.where("node <> group").select("node", "group", F.lit(False).alias("first"), F.pmod(salt, F.col("blocks")).alias("block"), "text")
    dealt = dealt.unionByName(many.where("node = group").select("node", "group", F.lit(True).alias("first"), each("blocks").alias("block"), "text"))
    full = map_batches(dealt.select("node", "group", "first", "block", "text"), run, "node bigint, group bigint, first boolean, block bigint, shingles binary")
    to_first = tables.cut(each_cell(full.select(F.xxhash64("group", "block").alias("cell"), "node", "group", "first", "shingles"), _to_first, "node bigint, group bigint, linked boolean, near boolean"))
    # the others meet each other, and those that are near meet all that are linked
    flags = to_first.groupBy("node", "group").agg(F.bool_and("linked").alias("linked"), F.bool_or("near").alias("near"))
    left = many.drop("group", "blocks").join(flags, "node")
    sums = lambda p: [F.count_if(p).alias("rows"), F.sum(F.when(p, F.col("bytes")).otherwise(0)).alias("bytes")]
    part = {name: left.groupBy("group").agg(*sums(p)).select("group", n_blocks("rows", "bytes").alias(name), (F.col("rows") > 0).alias(f"any_{name}")) for name, p in (("others", ~F.col("linked")), ("nears", ~F.col("linked") & F.col("near")), ("ones", F.col("linked")))}
    left = left.join(part["others"], "group").join(part["nears"], "group").join(part["ones"], "group")
    own, across = F.pmod(salt, F.col("others")), F.lit(7)
    among = left.where("not linked").select("node", "text", F.col("group").alias("g"), own.alias("b"), each("others").alias("w"))
    among = among.select("node", "text", F.xxhash64("g", F.least("b", "w"), F.greatest("b", "w")).alias("cell"))
    lines = left.where("not linked and near and any_ones").select("node", "text", "group", F.pmod(salt, F.col("nears")).alias("b"), each("ones").alias("w")).select("node", "text", F.xxhash64("group", across, "b", "w").alias("cell"))
    columns = left.where("linked and any_nears").select("node", "text", "group", each("nears").alias("b"), F.pmod(salt, F.col("ones")).alias("w")).select("node", "text", F.xxhash64("group", across, "b", "w").alias("cell"))
    cells = map_batches(among.unionByName(lines).unionByName(columns).select("cell", "node", "text"), run, "cell bigint, node bigint, shingles binary")
    edges = edges.unionByName(to_first.where("linked").select(F.least("node", "group").alias("a"), F.greatest("node", "group").alias("b")))
    return edges.unionByName(each_cell(cells, _linked, EDGE))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with all columns, one row of each group: that of its smallest doc_id, of repeated ids the first by
    text. Rows without doc_id stay."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    mark = "n" + "_" * max(map(len, ["", *docs.columns]))  # longer than any column's name
    one = docs.join(kept, "doc_id", "left_semi").withColumn(mark, first).where(F.col(mark) == 1).select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
