"""Corpus pipeline: stages over documents, each written as Parquet and reread as the next one's documents.

Toxic documents go, then those of low quality, then all but one of each group of near duplicates; personal data
become pseudonyms, and what is left is packed. Each stage works on all that the one before has kept.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from cubitgrid.llm import minhash, packing, pii, quality, toxicity
from cubitgrid.llm.common import read
from cubitgrid.llm.queries import PUBLIC_KEY
from cubitgrid.plans.tables import Tables


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled ones of these documents; keeps those under a score of 0.5.

    Null and empty texts have a score too. Without labels of both kinds none is rejected.
    """
    return toxicity.keep(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled ones of these documents; keeps those with a score of 0.3 or more.

    Null and empty texts have a score too. Labels of one kind give all their smoothed share as score; without labels
    it is 0.5, so none is rejected.
    """
    return quality.keep(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Of rows that repeat an id the first by text stays; rows without an id, and null and empty texts, stay. An empty
    table stays empty.
    """
    return minhash.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms under the key of the session's setting spark.cubitgrid.key; every row stays, null texts stay null.

    Without the setting the public key of the made-up tables is taken, which protects nothing: a warning says so.
    """
    key = spark.conf.get("spark.cubitgrid.key", "")
    if not key:
        warnings.warn("spark.cubitgrid.key is not set: pseudonyms are made with a public key and can be undone", stacklevel=2)
    return pii.replace_personal_data(docs, key or PUBLIC_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, as packing.pack() describes them; workers that ran the other stages remember fewer pieces."""
    return packing.pack(docs, with_ids=False, remembered=packing.bpe.REMEMBERED // 5)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Trained models and tokenizers decide the rows: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; every stage but the last is written to the shared folder and read again."""
    docs, tables = read(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        done = tables.cut(stage(spark, docs, sf_dir))
        tables.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
