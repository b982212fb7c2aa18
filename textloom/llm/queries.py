"""The queries of this subpackage, one per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chat, decontaminate, divergence, embedding_dedup, language, licenses, neural_lm, pieces, prefix_trie, quality, sharding, simhash, token_counts
from textloom.llm.common import table

SHARDS = 40
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by line; a null text has none, repeated rows count each, no rows give none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, RANKS)
    return counted.select("doc_id", "n_tokens", "n_crossing", "outside", F.col("section_tokens").cast("array<bigint>").alias("section_tokens"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; null or letterless texts are ``und``, ties go to the first name, repeated rows count each."""
    return language.identify(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; unsound vectors link with nothing, equal ones are linked, the smallest id names a component."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in each document; a null text has none, ties go to the shorter span, the earlier start and the first name."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct("license_matches.license")), ",")
    best = F.coalesce(F.round(F.array_max("license_matches.coverage"), 6), F.lit(0.0))
    return found.select("doc_id", F.size("license_matches").cast("long").alias("n_matches"), names.alias("licenses"), best.alias("best_coverage"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document; null texts score as empty ones, equal texts alike, no rows give none."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations read back as; nulls are empty strings, repeated rows turns of their own."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{probe}' AS text")
    return chat.digest(chat.expand(turns.unionByName(extra)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each document; null texts have no words, repeated rows count each, no rows give none."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document; a null text has size 16, equal keys go to one shard, repeated rows take slots of their own."""
    return sharding.shard_manifest(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document and whether they decode to it; null texts are empty, repeated rows count each."""
    ids = pieces.encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    listed = F.sha2(F.array_join("input_ids", ","), 256)
    return ids.select("doc_id", "n_tokens", "n_bytes", listed.alias("ids_sha256"), "round_trip")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; texts without words have print zero, the smallest id names a component."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and network scores of every document; null texts are empty, repeated rows count each, no rows give none."""
    return neural_lm.score_documents(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language and their telling terms; nulls are empty strings, ties go by item."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; nulls are empty strings, a null turn comes first, no rows give no nodes."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": chat.DIGEST_SQL, "op7_decontamination": decontaminate.DIGEST_SQL, "op12_source_divergence": divergence.AUDIT_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}
