"""The thirteen operators as queries over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import score_texts
from .common import ascii_lower, table
from .decontaminate import contamination
from .filter_audit import audit_filters, failure_cells
from .html_extract import extract_main_text
from .importance import resample
from .licenses import scan_licenses
from .manifest import fold, manifest, proof
from .mixing import mix_sources
from .quality_rules import quality
from .secrets import BASE, scan_secrets, span_digest
from .sharding import kd_shards
from .simhash import near_duplicates
from .url_filter import RULES, judge_urls

N_SHARDS = 8
#: The audited filters, in the order of a pattern's bits.
FILTERS = "ABCDE"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def shards_of(documents: DataFrame) -> DataFrame:
    return kd_shards(documents, n_shards=N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_of(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)  # noqa: E731  one argument each: a second one would be the span's position
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, RULES)
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), FILTERS)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    rows = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    folded = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("found")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda *places: F.array_join(F.sort_array(F.array_distinct(F.concat(*[F.transform(p, lambda x: x["label"]) for p in places]))), ",")
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named("base").alias("base_labels"), named("base", "found").alias("labels"), "score"
    )


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sharding": op2_sharding,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_brown_lm": op4_brown_lm,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_manifest": op12_manifest,
    "op13_licenses": op13_licenses,
}
