"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubitgrid.llm import chat, divergence, embeddings, encode, fingerprint, infilling, minhash, mixing, oracles, packing, pii, quality, secrets, toxicity
from cubitgrid.llm.common import read


#: A key for the given tables, which are made up: anyone can read it here, so it protects nothing.
PUBLIC_KEY = "synthetic tables"


def op1_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).selectExpr(f"stack(2, -1L, 0L, 'user', '{said}', -1L, 1L, 'assistant', '{said}') as (conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.windows(rows))


def op5_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), PUBLIC_KEY)


def op6_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(read(spark, sf_dir, "documents"))


def op7_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.digests(read(spark, sf_dir, "documents"))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find(read(spark, sf_dir, "documents")))


def op9_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_embedding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read(spark, sf_dir, "documents")).taken()


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(infilling.examples(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack_binary, op2_minhash_near_duplicates, op3_quality_discriminant, op4_chat_windows, op5_pii_feistel, op6_exact_digest, op7_bpe_prefixes, op8_secret_battery, op9_toxicity_kernel, op10_embedding_codes, op11_source_divergence, op12_source_mix, op13_fill_in_middle)}

#: The others rest on tokenizers, trained models, hashes or ciphers that SQL doesn't have; tests hold them to brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_duplicates": oracles.NEAR_DUPLICATES,
    "op4_chat_windows": oracles.chat_windows(),
    "op10_embedding_codes": oracles.EMBEDDINGS,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
