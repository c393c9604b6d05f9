"""The operators as queries over the given tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import alignment, bpe_arrays, bpe_monoid, context_tree, decontamination, host_rules, jaccard_join, mixing, sharding, stream_dedup, substrings, toxicity, whitening
from tallyflow.llm.common import documents
from tallyflow.llm.oracles import ORACLES


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_counts(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return context_tree.score(spark, docs, context_tree.train(docs))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", stream_dedup.sha256(F.col("kept_text")).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    counted = bpe_arrays.token_counts(spark, documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judged(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_monoid.encode_documents(spark, documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, digests=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.decisions(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(spark, docs, toxicity.train(docs, labels)).drop("n_windows")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scanned(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    counted = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), stream_dedup.sha256(F.array_join("items", ",")).alias("items_sha256"))
    return counted.withColumn("contaminated", F.col("n_hit") > 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.scored(alignment.aligned(documents(spark, sf_dir), a, b, digests=True))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_sharding, op3_context_tree, op4_jaccard_join, op5_substring_dedup, op6_token_counts, op7_quality_rules, op8_bpe, op9_exact_dedup, op10_toxicity, op11_decontamination, op12_token_alignment, op13_whitening)
}
