"""Packing by power-of-two decomposition: every sequence is one piece of one document, without padding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm import bpe
from cubitgrid.llm.common import map_batches, texts

END_ID = 2


def binary_lengths(n: int, most: int) -> list[int]:
    """Full sequences of `most`, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, most: int = 4096, end_id: int = END_ID, vocabulary: str = bpe.VOCABULARY, with_ids: bool = True, remembered: int = bpe.REMEMBERED) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    A document's ids (end_id comes last) are cut into power-of-two lengths, at most `most`; each piece is a
    sequence of its own, so none crosses documents and none is padded. bucket is log2 of the length; sequences
    of a bucket have equal lengths and batch without padding (see write_buckets). Null and empty texts give the
    one piece that holds end_id. Repeated rows and null ids are packed like any other row. ids only if with_ids. A worker remembers the ids of so many pieces
    of texts (remembered): fewer take less memory and more time.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the largest length must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    ids_type = pa.list_(pa.int32())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = bpe.library_ids(vocabulary, remembered).encode(texts(batch.column("text")))
        rows: list[tuple] = []
        pieces: list[np.ndarray] = []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws, strict=True):
            raw += end
            total, at = len(raw) // 4, 0
            for size in binary_lengths(total, most):
                piece = raw[4 * at : 4 * (at + size)]
                rows.append((doc_id, at, size, zlib.crc32(piece), total, size.bit_length() - 1))
                if with_ids:
                    pieces.append(np.frombuffer(piece, "<u4").astype("int32"))
                at += size
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        if with_ids:
            cols.append(pa.array(pieces, ids_type))
        return pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket bigint" + ", ids array<int>" * with_ids
    out = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences in one folder for each length, from which batches of equal lengths are read."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
