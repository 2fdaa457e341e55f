"""BPE encoding and decoding of whole documents."""

from __future__ import annotations

import hashlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm import bpe
from cubitgrid.llm.common import map_batches, texts


def encode(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. One row for each input row, repeated and
    null ids included; other columns don't matter. Texts of any length: a word is encoded in one pass.
    Characters that the library's Unicode tables treat otherwise than the installed ones are cut as it cuts them.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = bpe.encoder(vocabulary)
        ids = [np.array([i for c in b.chunks(t) for i in b.ids(c)], "int32") for t in texts(batch.column("text"))]
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([b.decode(x.tolist()) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the same encoder, without the ids themselves."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b, cache = bpe.entries(vocabulary)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        n, ids, decoded = [], [], []
        for t in texts(batch.column("text")):
            got = [cache[c] for c in b.chunks(t)]
            got = [x for x in got if x[0]]
            n.append(sum(map(itemgetter(0), got)))
            ids.append(sha(map(itemgetter(1), got)))
            decoded.append(sha(map(itemgetter(2), got)))
        return pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
