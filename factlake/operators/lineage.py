"""From facts back to bytes: provenance for all facts at once, and audits of the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def provenance(facts: DataFrame, retrieval: DataFrame, raw_document: DataFrame) -> DataFrame:
    """fact -> retrieval -> document. The 18 columns of the chain."""
    g = facts.select("fact_id", "locator", "extractor", "extractor_version", "extraction_run_id", "retrieval_id", "content_sha256", "source_doc_id", "source_doc_version", "knowledge_date")
    r = retrieval.select("retrieval_id", "provider_id", "source_tier", "dataset_id", "resource_key", "url", "retrieved_at")
    return g.join(r, "retrieval_id").join(raw_document.select("content_sha256", "size_bytes", "storage_path"), "content_sha256")


def lineage_gaps(facts: DataFrame, retrieval: DataFrame, raw_document: DataFrame) -> DataFrame:
    """fact_id, gap: facts whose retrieval or document is missing."""
    no_retrieval = facts.join(retrieval.select("retrieval_id"), "retrieval_id", "left_anti").select("fact_id", F.lit("retrieval").alias("gap"))
    no_document = facts.join(raw_document.select("content_sha256"), "content_sha256", "left_anti").select("fact_id", F.lit("document").alias("gap"))
    return no_retrieval.unionByName(no_document)


def rehashed(raw_document: DataFrame, content: DataFrame) -> DataFrame:
    """raw_document with actual_sha256 of the bytes that are stored now: content (content_sha256, content) by registered hash."""
    return raw_document.join(content.select("content_sha256", X.content_hash(F.col("content")).alias("actual_sha256")), "content_sha256")


def corrupt_facts(facts: DataFrame, rehashed: DataFrame) -> DataFrame:
    """fact_id of facts whose document's bytes (content_sha256, actual_sha256) no longer match."""
    return facts.join(rehashed.where("content_sha256 <> actual_sha256").select("content_sha256"), "content_sha256", "left_semi").select("fact_id")


def size_conflicts(observed: DataFrame) -> DataFrame:
    """Hashes seen with different sizes."""
    return observed.groupBy("content_sha256").agg(F.min("size_bytes").alias("low"), F.max("size_bytes").alias("high")).where("low <> high")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_locator_parts(facts: DataFrame) -> DataFrame:
    return facts.withColumns(X.locator_parts(F.col("locator")))
