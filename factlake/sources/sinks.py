"""Append-only sinks on Parquet tables. One writer at a time per table; re-running a batch adds nothing."""

from __future__ import annotations

import hashlib
import platform

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import fresh
from ..schemas import RUN_EVENT, RUN_STATUSES, struct
from .scratch import COMPRESSION, exists, free, live, written


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table; empty if nothing has been written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def new_rows(batch: DataFrame, existing: DataFrame, key: str, order: list[str] | None = None, prune: str | None = None) -> DataFrame:
    """Rows of batch whose key is new, one per key: the first by order. The first writer wins.

    prune names a column that the key is derived from; existing rows of other values are not read.
    """
    first = Window.partitionBy(key).orderBy(*(order or [c for c in batch.columns if c != key] or [key]))
    n = fresh(batch, "n")
    once = batch.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
    if prune:
        existing = existing.join(batch.select(prune).distinct(), prune, "left_semi")
    return once.join(existing.select(key), key, "left_anti")


#: Column by whose values appended tables are laid out in folders: the first digits of the hash that prunes them.
PREFIX, PREFIX_DIGITS = "hash_prefix", 2
#: Folder, in a table's own, that tells which of its files hold which values; readers of the table pass it by.
INDEX = "_values"
#: A prefix of more new rows is dealt out to several tasks.
ROWS_PER_FILE = 1_000_000
#: An append names the files that it reads up to this number; of more, it reads their folders.
MAX_NAMED_FILES = 10_000


def _folders(spark: SparkSession, path: str, schema, prefixes: list[str] | None) -> DataFrame:
    """The table, or its folders of the prefixes only; other folders are not even listed."""
    if prefixes is None:
        return read_table(spark, path, schema)
    there = [p for p in (f"{path}/{PREFIX}={x}" for x in prefixes) if exists(spark, p)]
    return spark.read.schema(schema).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str, schema, prefixes: list[str] | None) -> set[str]:
    """Names of a table's files, in the folders of the prefixes."""
    return set(_folders(spark, path, schema, prefixes).inputFiles())


def _index_schema(prune: str | None) -> str:
    return f"file string, value long{f', {PREFIX} string' if prune else ''}"


def candidate_files(spark: SparkSession, path: str, schema, values: DataFrame, prefixes: list[str] | None) -> tuple[list[str], set[str]]:
    """Files that may hold one of the values (a column value of 64-bit hashes), and all files of their folders.

    Files that the index does not speak of, as an append was cut off before it had written it, may hold any.
    """
    files = _files(spark, path, schema, prefixes)
    index = read_table(spark, f"{path}/{INDEX}", _index_schema(PREFIX if prefixes is not None else None))
    if prefixes is not None:
        index = index.where(F.col(PREFIX).isin(prefixes))
    spoken = {r.file: r.hit for r in index.join(values.select("value", F.lit(True).alias("met")).distinct(), "value", "left").groupBy("file").agg(F.coalesce(F.max("met"), F.lit(False)).alias("hit")).collect()}
    return sorted(f for f in files if spoken.get(f.rsplit("/", 1)[-1], True)), files


def append_new(batch: DataFrame, path: str, key: str, order: list[str] | None = None, prune: str | None = None, landed: bool = False) -> int:
    """Writes new_rows; the number written. One writer at a time a table.

    prune names a column of hexadecimal hashes that the key is derived from: the table has a folder
    for each of their prefixes (256). An index beside the table holds, per file, the 64-bit hashes of
    its values of prune (or of key), so that an append opens only files which hold a value of its batch;
    a file that is not in the index yet is opened too, so a cut-off append loses nothing.
    The batch is computed once (landed: it is read from files and not written again). Its rows and the keys
    of what is stored are shuffled once, by prefix and a piece of it, and written as they then lie; a prefix with many rows is written by many tasks.
    """
    spark, names = batch.sparkSession, batch.columns
    mine = live()
    value, old, piece, n = (fresh(batch, x) for x in ("value", "old", "piece", "n"))
    rows = batch
    if prune:
        rows = rows.withColumn(PREFIX, F.concat(F.lit("h"), F.substring(prune, 1, PREFIX_DIGITS)))  # a letter first, so that no prefix reads as a number
    stored = rows.schema
    rows = rows if landed else written(rows, "batch")
    counts = {r[0]: r[1] for r in rows.groupBy(PREFIX).count().collect()} if prune else {}  # as many as there are prefixes
    if prune and not counts:
        free(spark, [p for p in live() if p not in mine])
        return 0
    prefixes = list(counts) if prune else None
    files, before = candidate_files(spark, path, stored, rows.select(F.xxhash64(prune or key).alias(value)).select(F.col(value).alias("value")), prefixes)
    if len(files) > MAX_NAMED_FILES:
        existing = _folders(spark, path, stored, prefixes)
    else:
        existing = spark.read.schema(stored).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], stored)
    text = dict(batch.dtypes)[key] == "string"
    both = rows.withColumn(old, F.lit(0)).unionByName(existing.where(F.col(key).isNotNull()).select(*dict.fromkeys([*[PREFIX] * bool(prune), *[prune] * bool(prune), key]), F.lit(1).alias(old)), allowMissingColumns=True)
    if counts:
        pieces = F.element_at(F.create_map(*[F.lit(x) for p, c in counts.items() for x in (p, -(-c // ROWS_PER_FILE))]), F.col(PREFIX))
        both = both.withColumn(piece, F.pmod(F.xxhash64(key), pieces))
        dealt = [PREFIX, piece]
    else:
        dealt = [key]
    if text and counts:
        both = both.withColumn(key, X.packed(F.col(key)))
    tasks = sum(-(-c // ROWS_PER_FILE) for c in counts.values())
    # by number where a prefix has pieces, or small ones would be put together again
    both = both.repartition(tasks, *dealt) if tasks > len(counts) else both.repartition(*dealt)
    if text and counts:
        both = both.withColumn(key, X.unpacked(F.col(key)))
    # what is stored comes first, and is not written again
    first = Window.partitionBy(*dict.fromkeys([*dealt, key])).orderBy(F.col(old).desc(), *(order or [c for c in names if c != key] or [key]))
    rows = both.withColumn(n, F.row_number().over(first)).where((F.col(n) == 1) & (F.col(old) == 0)).select(*stored.names)
    if counts:
        rows = rows.sortWithinPartitions(PREFIX, prune, key)
    seen = Observation("written")
    out = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").option("compression", COMPRESSION)
    (out.partitionBy(PREFIX) if prune else out).parquet(path)
    count = seen.get["n"]
    if count:
        index_files(spark, path, stored, prune, key, sorted(_files(spark, path, stored, prefixes) - before))
    free(spark, [p for p in live() if p not in mine])
    return count


def index_files(spark: SparkSession, path: str, schema, prune: str | None, key: str, files: list[str]) -> None:
    """Adds files of a table to its index."""
    if files:
        found = spark.read.schema(schema).option("basePath", path).parquet(*files)
        rows = found.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.xxhash64(prune or key).alias("value"), *[PREFIX] * bool(prune)).distinct()
        rows.hint("rebalance").sortWithinPartitions(*[PREFIX] * bool(prune), "value").write.mode("append").parquet(f"{path}/{INDEX}")


def register_documents(observed: DataFrame, raw_document: DataFrame) -> DataFrame:
    """observed: content_sha256, size_bytes, media_type, storage_path, seen_at, run_id. A row per distinct content, is_new telling whether the catalog lacks it."""
    first = observed.groupBy("content_sha256").agg(F.min(F.struct("seen_at", "run_id", "size_bytes", "media_type", "storage_path")).alias("x"))
    rows = first.select("content_sha256", "x.size_bytes", "x.media_type", "x.storage_path", F.col("x.seen_at").alias("first_seen_at"), F.col("x.run_id").alias("first_seen_run_id"))
    known = raw_document.select("content_sha256", F.lit(True).alias("known")).distinct()
    return rows.join(known, "content_sha256", "left").withColumn("is_new", F.col("known").isNull()).drop("known")


def log_retrievals(retrievals: DataFrame, path: str) -> None:
    """Every observation is logged, changed or not."""
    retrievals.write.mode("append").parquet(path)


#: Folders of a batch in its tables and in the ledger.
BATCH = "batch"
_DONE = "step string, rows long"


def batch_identity(landed: DataFrame) -> str:
    """The same for the same rows, in any order; repeated rows count."""
    row = F.struct(*sorted(landed.columns))
    sums = landed.agg(*[F.coalesce(F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)], F.count(F.lit(1)).cast("string")).first()
    return "x" + hashlib.sha256("|".join(sums).encode()).hexdigest()[:24]


def _step_done(spark: SparkSession, ledger: str, step: str) -> bool:
    return not read_table(spark, f"{ledger}/{step}", _DONE).isEmpty()


def _mark(spark: SparkSession, ledger: str, step: str, rows: int) -> None:
    spark.range(1).select(F.lit(step).alias("step"), F.lit(rows).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{step}")


_OUTCOME = "retrieval_id string, resource_key string, content_sha256 string, is_new boolean"


def ingest_batch(landed: DataFrame, raw_document_path: str, retrieval_path: str, batch_id: str | None = None, ledger_path: str | None = None) -> DataFrame:
    """landed: the columns of retrieval plus size_bytes, media_type, storage_path. Registers, logs, and tells per retrieval whether its content was new.

    A ledger (beside the retrieval table, if no path is given) keeps a folder per batch: the outcome
    is written first, then the batch's own folders of both tables, a marker last. A batch that was cut
    off anywhere goes on from what is written when it is run again, a finished one returns the
    outcome on record, and the answer is read from the ledger, so no lost executor or later batch changes it. One writer at a
    time. Without batch_id a batch is known by its rows.
    """
    spark = landed.sparkSession
    batch_id = batch_id or batch_identity(landed)
    ledger = f"{ledger_path or retrieval_path.rstrip('/') + '-ledger'}/{BATCH}={batch_id}"
    outcome = f"{ledger}/outcome"
    if not _step_done(spark, ledger, "recorded"):
        observed = landed.select("content_sha256", "size_bytes", "media_type", "storage_path", F.col("retrieved_at").alias("seen_at"), "run_id")
        schema = "content_sha256 string, size_bytes bigint, media_type string, storage_path string, first_seen_at timestamp, first_seen_run_id string"
        # the batch's own folder, from an earlier try, is no earlier sighting
        earlier = read_table(spark, raw_document_path, f"{schema}, {BATCH} string").where(~F.col(BATCH).eqNullSafe(batch_id)).drop(BATCH)
        register_documents(observed, earlier).where("is_new").drop("is_new").write.mode("overwrite").parquet(f"{ledger}/documents")
        new = spark.read.parquet(f"{ledger}/documents").select("content_sha256", F.lit(True).alias("new"))
        first = Window.partitionBy("content_sha256").orderBy("retrieved_at", "retrieval_id")
        rows = landed.withColumn("nth", F.row_number().over(first)).join(new, "content_sha256", "left")
        rows.select("retrieval_id", "resource_key", "content_sha256", (F.col("new").isNotNull() & (F.col("nth") == 1)).alias("is_new")).write.mode("overwrite").parquet(outcome)
        landed.drop("size_bytes", "media_type", "storage_path").write.mode("overwrite").parquet(f"{ledger}/retrievals")
        _mark(spark, ledger, "recorded", spark.read.parquet(outcome).count())
    if not _step_done(spark, ledger, "done"):
        for name, path in (("documents", raw_document_path), ("retrievals", retrieval_path)):
            spark.read.parquet(f"{ledger}/{name}").write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        _mark(spark, ledger, "done", spark.read.parquet(outcome).count())
    return spark.read.schema(_OUTCOME).parquet(outcome)


def log_run_event(spark: SparkSession, path: str, run_id: str, command: str, status: str, notes: str | None = None, code_version: str | None = None, git_sha: str | None = None) -> None:
    """Appends what a run says of itself now: running, success or failed. A running event has the time as started_at, the others as finished_at."""
    if status not in RUN_STATUSES:
        raise ValueError(f"a run's status is one of {', '.join(RUN_STATUSES)}, not {status}")
    now, ended = F.current_timestamp(), status != RUN_STATUSES[0]
    values = {
        "run_id": F.lit(run_id), "command": F.lit(command), "status": F.lit(status), "started_at": F.lit(None) if ended else now, "finished_at": now if ended else F.lit(None),
        "event_ts": now, "code_version": F.lit(code_version), "runtime_version": F.lit(f"python {platform.python_version()}, spark {spark.version}"), "git_sha": F.lit(git_sha), "notes": F.lit(notes),
    }
    event = spark.range(1).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in struct(RUN_EVENT)])
    event.coalesce(1).write.mode("append").parquet(path)


def run_log(events: DataFrame) -> DataFrame:
    """A row per run: its first start, the end that its latest event tells (null while it runs), that event's status, and of all else what was said last.

    Of events of one time, an end counts as the later.
    """
    ended = F.col("finished_at").isNotNull()
    said = [c for c in ("command", "code_version", "runtime_version", "git_sha", "notes") if c in events.columns]
    when = F.struct("event_ts", ended, "status")
    latest = F.max(F.struct("event_ts", ended.alias("ended"), "status", "finished_at")).alias("latest")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in said]
    return events.groupBy("run_id").agg(latest, F.min("started_at").alias("started_at"), *kept).select("run_id", "started_at", "latest.finished_at", "latest.status", *said)


def current_runs(events: DataFrame) -> DataFrame:
    """The latest event of each run."""
    others = [c for c in events.columns if c not in ("run_id", "event_ts")]
    return events.groupBy("run_id").agg(F.max(F.struct("event_ts", *others)).alias("x")).select("run_id", *[f"x.{c}" for c in others], "x.event_ts")
