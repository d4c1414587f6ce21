"""Archives: ZIP files of Latin-1 ;-separated members, exploded to rows of named cells.

A member is the smallest unit, as record numbers are positional. Documents are split into
members first and members dealt out over the cluster, so that few large archives don't mean
few tasks.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import content_hash, fresh
from ..schemas import CELLS, INDEX_PATTERN, MEMBER_PATTERN, MEMBERS, SIDECAR, STATEMENTS, struct
from .scratch import written
from .sinks import read_table

#: Cells rows per batch that leaves a Python worker.
_ROWS = 5_000


def scan_documents(spark: SparkSession, path: str, pattern: str = "*", folders: list[str] | None = None) -> DataFrame:
    """Landed files: path, content_sha256, size_bytes, modified_at, content; of some folders only, if given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = files.load(folders) if folders else files.option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")


def verify_documents(documents: DataFrame) -> DataFrame:
    """Documents stored under the name of their hash: path, content_sha256, expected_sha256, ok."""
    expected = F.regexp_extract("path", "([^/]+?)(?:\\.[A-Za-z0-9]+)?$", 1)
    return documents.select("path", "content_sha256", expected.alias("expected_sha256"), (F.col("content_sha256") == expected).alias("ok"))


def with_intact(documents: DataFrame) -> DataFrame:
    """documents (content_sha256, content) with intact: whether the bytes match the hash (null bytes do not)."""
    return documents.withColumn("intact", F.coalesce(content_hash(F.col("content")) == F.col("content_sha256"), F.lit(False)))


def require_intact(documents: DataFrame) -> DataFrame:
    """documents (content_sha256, content); reading one whose bytes do not match its hash is an error that names it."""
    intact = content_hash(F.col("content")) == F.col("content_sha256")
    wrong = F.raise_error(F.concat(F.lit("content does not match its hash: "), F.col("content_sha256")))
    return documents.withColumn("content", F.when(intact, F.col("content")).otherwise(wrong.cast("binary")))


def list_members(documents: DataFrame, statements: list[str] | None = None) -> DataFrame:
    """content_sha256, member, content: known members, in order of name; statements prunes them before they are unpacked.

    A member leaves the worker before the next one is unpacked.
    """
    known = set(statements or STATEMENTS) & set(STATEMENTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, content in zip(b["content_sha256"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        m = re.match(MEMBER_PATTERN, name)
                        if re.match(INDEX_PATTERN, name) or m and m[1] in known:
                            yield pd.DataFrame({"content_sha256": [sha], "member": [name], "content": [z.read(name)]})

    return documents.select("content_sha256", "content").mapInPandas(run, MEMBERS)


def explode_members(members: DataFrame) -> DataFrame:
    """content_sha256, member, line_no, cells: a row per record, numbered from 2; cells by header name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, member, content in zip(b["content_sha256"], b["member"], b["content"], strict=True):
                rows: list[tuple] = []
                for n, cells in enumerate(csv.DictReader(io.StringIO(content.decode("latin-1"), newline=""), delimiter=";"), start=2):
                    rows.append((sha, member, n, {k: v for k, v in cells.items() if isinstance(k, str) and isinstance(v, str)}))
                    if len(rows) == _ROWS:
                        yield pd.DataFrame(rows, columns=["content_sha256", "member", "line_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["content_sha256", "member", "line_no", "cells"])

    return members.repartition("content_sha256", "member").mapInPandas(run, CELLS)


#: Bytes that are read of an archive at once, and cells' characters after which a batch leaves a worker.
_CHUNK, _BATCH_CHARS = 1 << 20, 4 << 20


def _opened(path: str):
    """A file that can be sought in, of any store that pyarrow reaches."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    return store.open_input_file(inner)


def central_directory(documents: DataFrame, statements: list[str] | None = None) -> DataFrame:
    """documents: path, content_sha256. content_sha256, path, member, member_bytes (unpacked), in order of name.

    Archives are read in chunks and held against their hash, which is an error that names one that
    does not match; statements prunes members before any is unpacked.
    """
    known = set(statements or STATEMENTS) & set(STATEMENTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, path in zip(b["content_sha256"], b["path"], strict=True):
                with _opened(path) as f:
                    found = hashlib.sha256()
                    while part := f.read(_CHUNK):
                        found.update(part)
                    if found.hexdigest() != sha:
                        raise ValueError(f"content does not match its hash: {sha}")
                    f.seek(0)
                    with zipfile.ZipFile(f) as z:
                        rows = [(sha, path, i.filename, i.file_size) for i in sorted(z.infolist(), key=lambda i: i.filename) if re.match(INDEX_PATTERN, i.filename) or (m := re.match(MEMBER_PATTERN, i.filename)) and m[1] in known]
                yield pd.DataFrame(rows, columns=["content_sha256", "path", "member", "member_bytes"])

    return documents.select("content_sha256", "path").mapInPandas(run, "content_sha256 string, path string, member string, member_bytes long")


def _record_batches(sha: str, path: str, member: str) -> Iterator[list[tuple]]:
    """A member's cells in batches of so many rows or characters; it is unpacked as it is read."""
    rows, chars = [], 0
    with _opened(path) as f, zipfile.ZipFile(f) as z, z.open(member) as packed:
        for n, cells in enumerate(csv.DictReader(io.TextIOWrapper(packed, "latin-1", newline=""), delimiter=";"), start=2):
            kept = {k: v for k, v in cells.items() if isinstance(k, str) and isinstance(v, str)}
            rows.append((sha, member, n, kept))
            chars += sum(map(len, kept.values()))
            if len(rows) == _ROWS or chars >= _BATCH_CHARS:
                yield rows
                rows, chars = [], 0
    if rows:
        yield rows


def stream_members(members: DataFrame) -> DataFrame:
    """The cells of members (as of central_directory): content_sha256, member, line_no, cells.

    A member is a task's unit, and its cells leave the worker in batches, so memory does not grow with the member or the archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, path, member in zip(b["content_sha256"], b["path"], b["member"], strict=True):
                for rows in _record_batches(sha, path, member):
                    yield pd.DataFrame(rows, columns=["content_sha256", "member", "line_no", "cells"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the largest first, dealt out one by one
    turn = fresh(members, "turn")
    dealt = members.withColumn(turn, F.row_number().over(Window.orderBy(F.col("member_bytes").desc(), "content_sha256", "member")))
    return dealt.repartition(n, turn).select("content_sha256", "path", "member").mapInPandas(run, CELLS)


def folder_digests(listing: DataFrame) -> DataFrame:
    """listing: path, size_bytes, modified_at. Per folder of hashes (its name's last two levels): files, and a sum of the rows' hashes, the same in any order."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return listing.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.xxhash64("path", "size_bytes", F.col("modified_at").cast("timestamp")).cast("decimal(38,0)")).cast("string").alias("digest"))


_AUDIT = "audit long, folder string, files long, digest string, wrong array<string>"


def audit_documents(spark: SparkSession, path: str, audits: str, pattern: str = "*", full: bool = False) -> DataFrame:
    """Documents stored under the name of their hash that hold other bytes: folder, wrong (their paths), of all folders.

    audits: a table with the outcome of earlier runs. Only folders whose files' names, sizes or times have
    changed since, and those that had wrong files, are read; what else holds is taken from the table.
    full=True reads all, as bytes may change below the files' times. An audit is in the table as a whole or not at all.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    now = written(folder_digests(listing), "folders")
    earlier = read_table(spark, audits, _AUDIT)
    number = (earlier.agg(F.max("audit")).first()[0] or 0) + 1
    last = earlier.where(F.col("audit") == number - 1).where(F.size("wrong") == 0).select("folder", "digest", F.lit(True).alias("same"))
    if full:
        last = last.limit(0)
    state = now.join(last, ["folder", "digest"], "left")
    changed = [r.folder for r in state.where("same is null").select("folder").collect()]  # as many as folders have changed
    if changed:
        checked = verify_documents(scan_documents(spark, path, pattern, changed)).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("path")))).alias("found"))
        state = state.join(checked, "folder", "left")
    else:
        state = state.withColumn("found", F.lit(None).cast("array<string>"))
    rows = state.select(F.lit(number).cast("long").alias("audit"), "folder", "files", "digest", F.coalesce("found", F.array().cast("array<string>")).alias("wrong"))
    rows.write.mode("append").parquet(audits)
    return read_table(spark, audits, _AUDIT).where(F.col("audit") == number).where(F.size("wrong") > 0).select("folder", "wrong")


def classify_members(cells: DataFrame) -> DataFrame:
    """Detail rows with statement, consolidated and member_year; unknown members are left out."""
    part = [F.regexp_extract("member", MEMBER_PATTERN, i) for i in (1, 2, 3)]
    return cells.withColumns({"statement": part[0], "consolidated": part[1] == "con", "member_year": part[2].try_cast("int")}).where(F.col("statement").isin(STATEMENTS))


def index_rows(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("member").rlike(INDEX_PATTERN))


def missing_index(documents: DataFrame, members: DataFrame, year: str = "year") -> DataFrame:
    """Documents (content_sha256, year) without the index member of their year."""
    have = members.select("content_sha256", F.regexp_extract("member", INDEX_PATTERN, 1).try_cast("int").alias(year)).where(F.col(year).isNotNull()).distinct()
    return documents.select("content_sha256", year).join(have, ["content_sha256", year], "left_anti")


def require_index(documents: DataFrame, members: DataFrame, year: str = "year") -> None:
    bad = [r.content_sha256 for r in missing_index(documents, members, year).limit(20).collect()]
    if bad:
        raise ValueError(f"index member missing in: {', '.join(bad)}")


def scan_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Provenance sidecars: document and provenance structs."""
    return spark.read.schema(struct(SIDECAR)).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def documents_from_sidecars(sidecars: DataFrame) -> DataFrame:
    """raw_document, rebuilt: the first sighting of each content."""
    d = sidecars.select("document.*")
    return d.groupBy("content_sha256").agg(F.min(F.struct("first_seen_at", *[c for c in d.columns if c not in ("content_sha256", "first_seen_at")])).alias("x")).select(
        "content_sha256", "x.size_bytes", "x.media_type", "x.storage_path", "x.first_seen_at", "x.first_seen_run_id"
    )
