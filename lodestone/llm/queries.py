"""The contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, decontaminate, langid, license, linedup, lm, neardup, pack, periodic, quality, secrets, substring, suffixdedup

HEX_OF = lambda c: F.sha2(c, 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir)).drop("matches")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(documents(spark, sf_dir), k=4, percent=80)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(documents(spark, sf_dir)).drop("kept_chars")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", langid.held_out(parts=5, part=1).alias("held_out"))
    return lm.score(docs, "held_out")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.contamination(documents(spark, sf_dir), benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", HEX_OF(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all the words of a benchmark passage of five words close together, by item; the other result of the index."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.search(documents(spark, sf_dir), benchmark, window=5, reach=8)
    return found.groupBy("doc_id", "item_id").agg(F.count(F.when(F.col("kind") == "near", 1)).alias("n_near"), F.count(F.when(F.col("kind") == "phrase", 1)).alias("n_phrases"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", HEX_OF(F.col("base_spans")).alias("base_sha256"), "spans")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.scan(periodic.with_planted_runs(documents(spark, sf_dir))).select("doc_id", *periodic.digests())


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_language_id, op5_quality_rules, op6_substring_dedup, op7_lm_scoring, op8_decontamination, op9_packing, op10_secrets, op11_periodic_runs, op12_token_alignment, op13_line_dedup, decontamination_proximity)}
