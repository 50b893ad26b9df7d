"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .common import ship_package
from .decontaminate import decontaminate
from .html_extract import extract
from .importance import resample
from .lang_id import identify
from .lm_score import lm_score
from .oracle import SQL
from .piecewise_hash import piecewise_hashes
from .quality import assess
from .sentencepiece_codec import encode
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import Ledger, changes, count_tokens
from .whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, loaded by one tokenizer version and revised to another; the benchmark's items, loaded by mistake
    and deleted. Every batch is retried, which changes nothing, and some are folded in between. Totals are those of the
    documents by the later version."""
    folder = f"{shared_folder(spark)}/token_ledger/{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents")
    items = _read(spark, sf_dir, "benchmark").selectExpr("item_id", "text", "'benchmark' source", "cast(null as string) lang")
    # counts of each document are kept: they are what deletes and revisions take off
    counted = {}
    for name, found in {"old": count_tokens(docs, "byte_bpe_multi_50k"), "new": count_tokens(docs), "items": count_tokens(items, "byte_bpe_multi_50k", "item_id")}.items():
        found.write.parquet(f"{folder}/counts/{name}")
        counted[name] = spark.read.parquet(f"{folder}/counts/{name}")
    ledger = Ledger(spark, folder)
    batches = {"load": changes(inserted=counted["old"].union(counted["items"])), "takedown": changes(deleted=counted["items"]), "tokenizer": changes(revised=(counted["old"], counted["new"]))}
    for name, signed in batches.items():
        ledger.commit(name, signed)
        ledger.commit(name, signed)
        if name == "takedown":
            ledger.compact()
    ledger.commit("load", batches["load"])
    return ledger.totals()


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of squares as a long; null where a long can't hold it."""
    return whiten(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piecewise_hashes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3's rows SQL can express."""
    return op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7's rows SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece_codec, op2_substring_dedup, op3_lm_scoring, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_html_extraction, op7_quality_rules, op8_token_counts, op9_language_id, op10_simhash_near_dedup, op11_embedding_whitening, op12_importance_resampling, op13_document_fingerprints, lm_base_scores, quality_counts)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
