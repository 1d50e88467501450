"""Queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    decision_list,
    id_shards,
    jump_shards,
    link_trust,
    multi_index,
    permuterm,
    positional_index,
    relative_lz,
    secret_scan,
    source_mixture,
    statements,
    tensor_minhash,
    trie_counts,
    turn_repair,
)
from touchline.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = statements.STATEMENTS


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_relative_lz(spark: SparkSession, folder: str) -> DataFrame:
    return relative_lz.parsed(_table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@_query
def op2_id_shards(spark: SparkSession, folder: str) -> DataFrame:
    return id_shards.read_shards(*id_shards.write_shards(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))


#: The rules that the query is asked to apply.
URL_RULES = [
    link_trust.Rule("com/", "allow"),
    link_trust.Rule("example.com/en/", "block"),
    link_trust.Rule("www.example.com/en/", "allow"),
    link_trust.Rule("net/es/", "block"),
    link_trust.Rule("net/fr/", "block"),
]


@_query
def op3_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    judged = link_trust.judge(_table(spark, folder, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query
def op4_tensor_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = tensor_minhash.near_duplicates(_table(spark, folder, "documents"), width=3, percent=85, collections=16, per_collection=3)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


@_query
def op5_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    judged = decision_list.judge(documents, decision_list.fit(documents, _table(spark, folder, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op6_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trie_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_token_efficiency_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "documents").select("doc_id", "text")
    scanned = secret_scan.find_secrets(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "spans")
    listed = lambda kinds: F.concat_ws(
        ",", F.transform(F.filter("spans", lambda s: s.kind.isin(*kinds)), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(secret_scan.KINDS[:3]), 256).alias("base_sha256"), listed(secret_scan.KINDS).alias("spans"))


@_query
def op8_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = jump_shards.shard_rows(_table(spark, folder, "documents"), 24)
    return placed.select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard")
    )


@_query
def op9_hypergeometric_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mixture.mixture(_table(spark, folder, "documents").select("doc_id", "text", "source"), ["doc_id"])
    return mixed.select(
        "doc_id", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), source_mixture.taken_words().alias("taken"),
        F.array_join(F.transform("_m_draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"])), ",").alias("draws"),
    )


@_query
def op10_positional_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = positional_index.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        positional_index.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@_query
def op11_cyk_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    found = turn_repair.with_all(turn_repair.repaired(turn_repair.damaged(rows)), rows)
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@_query
def op12_permuterm_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = permuterm.lettered_words(_table(spark, folder, "documents"), damage=31, letters=7)
    return permuterm.variants(materialize(words.where("n >= 2"))).select("word", "form", "root", "n", "n_near", "form_n")


@_query
def op13_multi_index_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(multi_index.usable(_table(spark, folder, "embeddings")), F.col("id") % 20 == 0)
