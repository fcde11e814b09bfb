"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_to_next

    return compare_to_next(_table(spark, sf_dir, "documents"))


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_repeated_lines

    cut = remove_repeated_lines(_table(spark, sf_dir, "documents"))
    return cut.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept_text").alias("kept_md5"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import tokens
    from .packing import pack

    docs = _table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", tokens(F.col("text")).alias("tokens"), "source", F.md5("text").alias("cluster")))


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import judge

    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return judge(_table(spark, sf_dir, "documents"), labels)


def op8_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    return detect(_table(spark, sf_dir, "documents"), redact=False).drop("redacted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",").alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    judged = judge(_table(spark, sf_dir, "documents"), labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def op11_kd_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import build, search

    return search(build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_minhash_forest, op2_language_bitmask, op3_lz_fingerprint, op4_raked_mixture, op5_line_runs, op6_best_fit_packing, op7_toxicity_ftrl, op8_pii_boosted, op9_suffix_dedup, op10_quality_rules, op11_kd_centroids, op12_warc, op13_maxscore)}
