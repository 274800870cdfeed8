"""The ``opN_`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import conversation_repair, decontaminate, license_scan, line_dedup, merkle, mix_sources, near_dedup, oracles, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup, url_filters
from quillon.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), s=near_dedup.Settings(size=2))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules that op3 applies, as action, host, path.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.rules_table(spark, URL_RULES))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents"), model)


#: Target weights: the source that has a third of all rows down to a tenth of the listed four, two small ones up.
MIX_WEIGHTS = {"src0": 1.0, "src1": 3.0, "src2": 3.0, "src3": 3.0}


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.apply_rules(docs).drop("source")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns replace the texts before the exchange."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.place(text).alias("place"), sharding.text_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    out = sharding.sharded_at(docs, F.col("place"), sharding.place(F.col("doc_id")), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
