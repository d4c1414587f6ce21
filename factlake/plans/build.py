"""Build: archives to silver to gold, one job over all documents; re-running it adds nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gold import to_facts
from ..operators.quality import NOT_LOSSES, loss_totals, write_counted
from ..operators.silver import document_index, index_entries, split_quarantine, to_silver
from ..schemas import GOLD_REASONS, SILVER_REASONS
from ..sources.archives import central_directory, classify_members, explode_members, index_rows, list_members, require_index, require_intact, stream_members
from ..sources.sinks import append_new


@dataclass
class Built:
    """What a build read and made. cells, typed and facts are written tables: archives are read once.

    counts: per stage the rows of every reason ('ok' for none), taken by the jobs that wrote the tables.
    """

    cells: DataFrame
    index: DataFrame
    typed: DataFrame
    facts: DataFrame
    counts: dict[str, dict[str, int]]

    @property
    def silver(self) -> DataFrame:
        return split_quarantine(self.typed)[0]

    @property
    def silver_rejected(self) -> DataFrame:
        return split_quarantine(self.typed)[1]

    @property
    def gold(self) -> DataFrame:
        return split_quarantine(self.facts)[0].drop("metric")

    @property
    def gold_rejected(self) -> DataFrame:
        return split_quarantine(self.facts)[1]

    def report(self) -> DataFrame:
        """stage, reason, rows. Nothing is read again."""
        rows = [(stage, reason, n) for stage, found in self.counts.items() for reason, n in found.items() if n]
        return self.typed.sparkSession.createDataFrame(rows, "stage string, reason string, rows long")

    def totals(self) -> DataFrame:
        """stage, read, emitted, lost (filtered rows are no loss), filtered, from the same counts."""
        rows = []
        for stage, found in self.counts.items():
            filtered = sum(found.get(r, 0) for r in NOT_LOSSES)
            rows.append((stage, sum(found.values()), found["ok"], sum(found.values()) - found["ok"] - filtered, filtered))
        return self.typed.sparkSession.createDataFrame(rows, "stage string, read long, emitted long, lost long, filtered long")

    def document_report(self) -> DataFrame:
        """Per document: members parsed, keys that the index leaves ambiguous, and per stage the rows read, emitted, lost and filtered."""
        document = "content_sha256"
        members = classify_members(self.cells).groupBy(document).agg(F.sort_array(F.collect_set("member")).alias("members"))
        ambiguous = self.index.groupBy(document).agg(F.count(F.when(F.col("is_ambiguous"), 1)).alias("ambiguous_keys"))
        out = self.cells.select(document).distinct().join(members, document, "left").join(ambiguous, document, "left")
        for stage, rows in (("silver", self.typed), ("gold", self.facts)):
            totals = loss_totals(rows, [document])
            out = out.join(totals.select(document, *[F.col(c).alias(f"{stage}_{c}") for c in totals.columns[1:]]), document, "left")
        return out.fillna(0)


def build(documents: DataFrame, run_id: str, work: str, companies: list[int] | None = None, statements: list[str] | None = None) -> Built:
    """documents: content_sha256, retrieval_id, year, and content or path. work: a folder that driver and executors share, new for each run.

    By content, an archive's bytes are a row and are unpacked once; by path, members are listed from its
    central directory, dealt out over the cluster and unpacked as they are read, so neither archive nor member has to fit in memory.
    Every archive's bytes are held against its hash; a corrupt one, one
    without its index member, and an empty selection are errors. Empty lists are no filters.
    """
    spark = documents.sparkSession
    documents.select("content_sha256", "retrieval_id", "year").write.parquet(f"{work}/documents")
    names = spark.read.parquet(f"{work}/documents")
    if names.isEmpty():
        raise ValueError("no documents to build")
    if "content" in documents.columns:
        read = explode_members(list_members(require_intact(documents), statements))
    else:
        central_directory(documents, statements).write.parquet(f"{work}/members")
        read = stream_members(spark.read.parquet(f"{work}/members"))
    read.write.parquet(f"{work}/cells")
    cells = spark.read.parquet(f"{work}/cells")
    require_index(names, cells.select("content_sha256", "member").distinct())
    index = document_index(index_entries(index_rows(cells)))
    details = classify_members(cells).join(names.select("content_sha256", "retrieval_id"), "content_sha256")
    silver = write_counted(to_silver(details, index, run_id, companies, statements), f"{work}/typed", SILVER_REASONS)
    typed = spark.read.parquet(f"{work}/typed")
    gold = write_counted(to_facts(split_quarantine(typed)[0]), f"{work}/facts", GOLD_REASONS)
    return Built(cells, index, typed, spark.read.parquet(f"{work}/facts"), {"silver": silver, "gold": gold})


def write(built: Built, silver_path: str, gold_path: str) -> tuple[int, int]:
    """New silver rows and facts written."""
    return append_new(built.silver, silver_path, "silver_id", ["retrieval_id"], "content_sha256"), append_new(built.gold, gold_path, "fact_id", ["retrieval_id"], "content_sha256")


def unbuilt(build_log: DataFrame, documents: DataFrame, extractor_version: str) -> DataFrame:
    """Documents that this extractor version has not built yet; build_log: content_sha256, extractor_version."""
    return documents.join(build_log.where(F.col("extractor_version") == extractor_version).select("content_sha256"), "content_sha256", "left_anti")
