"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, cap_filters, ctw, fm_index, lang_id, license_join, line_dedup, mixing, order_minhash, packing, source_audit, suffix_dedup, tput
from .common import read


def op1_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op3_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = avi.read_media(avi.encode_avi(read(spark, sf_dir, "documents")))
    return read_back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", avi.feature().alias("feature"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents"))


def op8_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(read(spark, sf_dir, "documents"))


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


def op13_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_family_svm, op2_pareto_mix, op3_avi_clips, op4_order_minhash, op5_winnow_lines, op6_cost_packing, op7_context_tree, op8_suffix_buckets, op9_license_join, op10_cap_filters, op11_tput_search, op12_source_audit, op13_fm_index)}

ORACLE_SQL: dict[str, str] = {"op2_pareto_mix": mixing.MIX_SQL, "op9_license_join": license_join.SCAN_SQL, "op5_winnow_lines": line_dedup.DEDUP_SQL, "op8_suffix_buckets": suffix_dedup.REPEATS_SQL, "op10_cap_filters": cap_filters.NEAR_SQL, "op11_tput_search": tput.SEARCH_SQL, "op12_source_audit": source_audit.AUDIT_SQL, "op13_fm_index": fm_index.LEAK_SQL}
