"""The queries of this package, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_trie, decontamination, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, sharding, token_alignment, token_output, toxicity
from .oracles import ORACLE_SQL  # noqa: F401
from .shared import id_crc, table

SHARDS = 40
MIX = mixing.MixPlan(
    share=(3, 5),
    max_epochs=4,
    seed="mix-1",
    domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    lang_weights={"en": 6, "de": 2, "fr": 2, "es": 1},
)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    plain, grown = [1.0] * SHARDS, [1.0] * (SHARDS + 1)
    sharded = sharding.assign_shards(docs, plain, grown_weights=grown)
    numbered = sharding.number_slots(sharded, ties=("text_crc32", "size"), cells=1024)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d, l, s = mixing.LEVELS
    return mixing.mix(docs, MIX).select(
        "doc_id",
        F.col(d).alias("domain"),
        F.col(l).alias("lang"),
        F.col(s).alias("source"),
        mixing.count_tokens(F.col("text")).alias("n_tokens"),
        "copies",
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=90)


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(table(spark, sf_dir, "documents"))


def _without_lines(spark: SparkSession, sf_dir: str, rules: line_dedup.LineRules) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, rules).select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_lines(spark, sf_dir, line_dedup.SQL_RULES)


def op1_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator with its own rules, which op1_line_templates' SQL does not have."""
    return _without_lines(spark, sf_dir, line_dedup.LineRules())


def op2_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.clean_vectors(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc("doc_id"), F.lit(4)) == 2
    model = language_id.fit(docs, where=~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(id_crc("doc_id"), F.lit(3)) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_templates": op1_line_templates,
    "op1_recurring_lines": op1_recurring_lines,
    "op2_rp_forest_neighbours": op2_rp_forest_neighbours,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_mix_sources": op5_mix_sources,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_token_orc": op7_token_orc,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}
