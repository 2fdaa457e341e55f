"""Exact fingerprints of texts in canonical form."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.common import SLICE_ROWS, map_batches, texts
from cubitgrid.plans.shipping import ship


def canonical(text: str) -> str:
    """Compatibility form, case folded, white space folded to single blanks; folding can undo composition."""
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical, fingerprint) of each row; null is the empty text, which has a fingerprint too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        canon = [canonical(t) for t in texts(batch.column("text"))]
        return pa.record_batch([batch.column("doc_id"), pa.array(canon, pa.string()), pa.array(map(digest, canon), pa.string())], names=["doc_id", "canonical", "fingerprint"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, canonical string, fingerprint string")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(fingerprint, group_id, n_copies): group_id is the smallest doc_id with these canonical bytes.

    Rows are grouped by the wide hash and, inside equal hashes, by their bytes, with partial sums before the shuffle: a
    hot text is one row a task. Null ids count as copies and never name a group that has another id.
    """
    each = fingerprints(docs).groupBy("fingerprint", "canonical").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("group_id"))
    return each.select("fingerprint", "group_id", "n_copies")


def edited_likeness(docs: DataFrame, rows_per_range: int = 2_000, most_ranges: int = 10_000) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how both compare.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edit takes the
    last quarter of the code points away and appends as many of the next document's first ones; documents are
    ordered by doc_id (nulls first, equal ids by text) and the last is followed by the first. An exact digest
    knows equal or not: likeness is 1 if fingerprints and canonical bytes are equal, else 0.

    Texts are dealt by ranges of doc_id, once; beyond most_ranges, ranges grow longer instead of more. Each range's
    first row goes to the range before as well; only these ids, one for each range, are gathered. A single row is followed by itself; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = min(max(1, n // rows_per_range), most_ranges)
    cuts = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100_000).alias("c")).first()["c"] if ranges > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype="int64"))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy("int64"), side="right").astype("int32"))

    firsts = sorted((r["range"], r["first"]) for r in rows.select("key", range_of("key").alias("range")).groupBy("range").agg(F.min("key").alias("first")).collect())
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    heads = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "first bigint, before int")
    # of rows with the range's first id, the one with the smallest text comes first
    head = rows.join(F.broadcast(heads), rows["key"] == heads["first"]).groupBy("before").agg(F.min("text").alias("text"))
    dealt = rows.select(range_of("key").alias("range"), F.lit(0).alias("after"), "key", "doc_id", "text").unionByName(head.select(F.col("before").alias("range"), F.lit(1).alias("after"), F.lit(0).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("doc_id"), "text"))
    dealt = dealt.repartition(max(1, len(firsts)), "range").sortWithinPartitions("range", "after", "key", "text").select("after", "doc_id", "text")

    def run(batches):
        held = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for after, doc_id, text in zip(part.column("after").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    canon = canonical(text)
                    fp = digest(canon)
                    if held is not None:
                        key, own, own_canon, own_fp = held
                        k = len(own) // 4
                        edited = own[: len(own) - k] + text[:k]
                        edited_canon = own_canon if edited == own else canonical(edited)
                        edited_fp = own_fp if edited == own else digest(edited_canon)
                        out.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_fp, edited_fp, float(edited_fp == own_fp and edited_canon == own_canon), float(fp == own_fp and canon == own_canon)))
                    held = None if after else (doc_id, text, canon, fp)
                if out:
                    yield flush()

    return dealt.mapInArrow(run, schema)
