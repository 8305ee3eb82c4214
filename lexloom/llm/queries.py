"""Queries opN_<name>: the operators of this folder over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_digests
from .bpe import encode
from .common import sha256_of
from .decontaminate import contaminated_words
from .html import extract_text
from .neardup import near_duplicates
from .negatives import mine
from .packing import pack
from .quality import judge
from .repeats import remove_repeats
from .secrets import find_secrets
from .toxicity import score_toxicity
from .urls import filter_urls
from .weaklabel import classify


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", sha256_of("kept_text").alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", sha256_of("base_spans").alias("base_sha256"), "spans", "n_random")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.array_join("evidence", ",").alias("evidence"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = sha256_of(F.array_join("items", ",")).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment_digests(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings"), moved)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(_table(spark, sf_dir, "documents"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha256_of("decoded").alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_templates, op2_quality_rules, op3_html_text, op4_substring_dedup, op5_secret_scan,
        op6_toxicity, op7_decontaminate, op8_best_fit_packing, op9_weak_quality, op10_near_duplicates,
        op11_token_alignment, op12_hard_negatives, op13_bpe_round_trip,
    )
}
