"""The operators' queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, licenses, near_dedup, packing, quality_classifier, quality_rules, token_files, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extraction(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches: how many, which licenses, the best coverage, the first span in words, and every match as license:start-end:coverage in percent."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    m = F.col("matches")
    return found.select(
        "doc_id",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"]))), ",").alias("licenses"),
        F.array_max(F.transform(m, lambda x: x["coverage"])).alias("coverage"),
        F.get(m, F.lit(0))["start"].cast("long").alias("first_start"),
        F.get(m, F.lit(0))["end"].cast("long").alias("first_end"),
        F.array_join(F.transform(m, lambda x: F.format_string("%s:%d-%d:%.2f", x["license"], x["start"], x["end"], 100 * x["coverage"])), ";").alias("spans"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_html_extraction": op2_html_extraction,
        "op3_language_id": op3_language_id,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_license_scan": op9_license_scan,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE_SQL, "op5_minhash_near_dedup": near_dedup.ORACLE_SQL, "op7_benchmark_decontamination": decontaminate.ORACLE_SQL}
