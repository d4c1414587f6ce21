"""Documents and their observations: versions, changes and totals."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SOURCE_TIERS


def first_observations(retrieval: DataFrame) -> DataFrame:
    """Per (dataset_id, resource_key, content_sha256) its earliest retrieval: retrieval_id, first_seen_at."""
    return retrieval.groupBy("dataset_id", "resource_key", "content_sha256").agg(F.min(F.struct("retrieved_at", "retrieval_id")).alias("x")).select(
        "dataset_id", "resource_key", "content_sha256", "x.retrieval_id", F.col("x.retrieved_at").alias("first_seen_at")
    )


def documents_for(retrieval: DataFrame, raw_document: DataFrame, dataset_id: str, resource_keys: list[str] | None = None, supported: list[str] | None = None) -> DataFrame:
    """Versions to build: one row per (resource_key, content), rewritten versions included, in order of first sight."""
    if supported is not None and dataset_id not in supported:
        raise ValueError(f"no builder for dataset {dataset_id}")
    rows = retrieval.where(F.col("dataset_id") == dataset_id)
    if resource_keys:  # none, or an empty list, is no filter
        rows = rows.where(F.col("resource_key").isin(list(resource_keys)))
    return first_observations(rows).join(raw_document, "content_sha256").orderBy("resource_key", "first_seen_at", "retrieval_id")


def resource_versions(retrieval: DataFrame, raw_document: DataFrame) -> DataFrame:
    """Per resource and content: first_seen, last_seen, times_seen, size_bytes, last_modified."""
    seen = retrieval.groupBy("dataset_id", "resource_key", "content_sha256").agg(
        F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"), F.count(F.lit(1)).alias("times_seen"), F.max("last_modified").alias("last_modified")
    )
    return seen.join(raw_document.select("content_sha256", "size_bytes"), "content_sha256")


def changed_resources(retrieval: DataFrame) -> DataFrame:
    """Resources with more than one content: versions."""
    once = retrieval.groupBy("dataset_id", "resource_key", "content_sha256").agg(F.lit(1).alias("one"))
    return once.groupBy("dataset_id", "resource_key").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


def top_changed(retrieval: DataFrame, n: int = 10) -> DataFrame:
    return changed_resources(retrieval).orderBy(F.col("versions").desc(), "dataset_id", "resource_key").limit(n)


def catalog_totals(raw_document: DataFrame, retrieval: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: documents, bytes, retrievals, runs."""
    none = F.lit(0).cast("long")
    parts = [
        raw_document.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size_bytes"), none).alias("bytes")).select("documents", "bytes", none.alias("retrievals"), none.alias("runs")),
        retrieval.agg(F.count(F.lit(1)).alias("retrievals")).select(none.alias("documents"), none.alias("bytes"), "retrievals", none.alias("runs")),
        runs.agg(F.count(F.lit(1)).alias("runs")).select(none.alias("documents"), none.alias("bytes"), none.alias("retrievals"), "runs"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(c).alias(c) for c in ("documents", "bytes", "retrievals", "runs")])


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The n latest runs; of those started at the same time, the lower run_id first."""
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(n)


def tier_at_least(rows: DataFrame, tier: str) -> DataFrame:
    """Rows whose source_tier is tier or stronger."""
    return rows.where(F.col("source_tier").isin(SOURCE_TIERS[: SOURCE_TIERS.index(tier) + 1]))


def tier_share(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_tier").agg(F.count(F.lit(1)).alias("rows"))


def parse_years(spec: str, min_year: int, max_year: int | None = None) -> list[int]:
    """'2024', '2020-2024' or '2020,2022' as sorted years; reversed, malformed, empty or out-of-range specs are errors."""
    last, years = max_year or date.today().year, set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"([0-9]{4})(?:\s*-\s*([0-9]{4}))?", part)
        if not m:
            raise ValueError(f"not a year or a range of years: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        if low > high:
            raise ValueError(f"reversed range: {part!r}")
        years.update(range(low, high + 1))
    if not years:
        raise ValueError("no year given")
    if min(years) < min_year or max(years) > last:
        raise ValueError(f"years must lie in {min_year} to {last}")
    return sorted(years)


def year_filter(rows: DataFrame, column: str, spec: str, min_year: int, max_year: int | None = None) -> DataFrame:
    return rows.where(F.col(column).isin(parse_years(spec, min_year, max_year)))
