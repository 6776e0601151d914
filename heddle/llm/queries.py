"""The queries of this subpackage's operators: thin wrappers, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import chat, decontaminate, gif, oracles, packing, sharding, simhash, suffixes, tokenfile, toxicity, urls
from heddle.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.document_media(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(turns.unionByName(extra))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_decontamination, op4_token_output, op5_media_columns, op6_packing, op7_simhash, op8_sharding, op9_chat_formatting, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": oracles.OP2, "op9_chat_formatting": oracles.OP9, "op10_suffix_dedup": oracles.OP10}
