"""Appends that open only the files they must, and ingests that survive retries and lost blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factlake.sources import sinks
from factlake.sources.sinks import INDEX, PREFIX, append_new, candidate_files, ingest_batch, read_table


def rows(spark, keys):
    """keys: (id, sha)."""
    return spark.createDataFrame(keys, "id string, sha string")


def test_files_without_a_candidate_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(4):
        assert append_new(rows(spark, [(f"{batch}-{i}", f"aa{batch}{i % 3}") for i in range(30)]), path, "id", prune="sha") == 30
    schema = read_table(spark, path, f"id string, sha string, {PREFIX} string").schema
    asked = rows(spark, [("2-1", "aa21"), ("new", "aa21")])
    files, every = candidate_files(spark, path, schema, asked.select(F.xxhash64("sha").alias("value")), ["haa"])
    assert len(every) == 4 and len(files) == 1
    assert {r.sha for r in spark.read.parquet(*files).collect()} == {"aa20", "aa21", "aa22"}
    for f in every - set(files):  # what is not read may as well be no Parquet
        with open(f.removeprefix("file://"), "wb") as out:
            out.write(b"broken")
    for f in tmp_path.rglob(".*.crc"):
        f.unlink()
    assert append_new(asked, path, "id", prune="sha") == 1
    assert append_new(asked, path, "id", prune="sha") == 0


def test_a_batch_of_one_prefix_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 4_000)
    path, key = str(tmp_path / "t"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    batch = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("ab"), F.substring(F.sha2((F.col("id") % 50).cast("string"), 256), 1, 62)).alias("sha"))
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")
    try:
        assert append_new(batch, path, "id", prune="sha") == 40_000
        assert append_new(batch, path, "id", prune="sha") == 0
    finally:
        spark.conf.set(key, before)
    assert len(spark.read.parquet(path).inputFiles()) >= 4 and spark.read.parquet(path).count() == 40_000


def test_an_append_cut_off_before_its_index_is_seen_by_the_next(spark, tmp_path, monkeypatch):
    path, batch = str(tmp_path / "t"), rows(spark, [(f"k{i}", f"0{i % 3}") for i in range(20)])
    monkeypatch.setattr(sinks, "index_files", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        append_new(batch, path, "id", prune="sha")
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 20
    assert append_new(batch, path, "id", prune="sha") == 0
    assert append_new(batch.unionByName(rows(spark, [("k99", "00")])), path, "id", prune="sha") == 1


def test_append_without_folders_has_an_index_too(spark, tmp_path):
    path = str(tmp_path / "t")
    for lot in (range(10), range(5, 15), range(15), range(0)):
        batch = spark.createDataFrame([(f"k{i}", i, i) for i in lot], "id string, value int, n int")
        want = len([i for i in lot if i not in getattr(test_append_without_folders_has_an_index_too, "seen", set())])
        assert append_new(batch, path, "id") == want
        test_append_without_folders_has_an_index_too.seen = getattr(test_append_without_folders_has_an_index_too, "seen", set()) | set(lot)
    assert spark.read.parquet(path).count() == 15 and spark.read.parquet(f"{path}/{INDEX}").count() == 15


def landed(spark, *rows):
    return spark.createDataFrame(rows, "retrieval_id string, content_sha256 string, day int").select(
        "retrieval_id", "content_sha256", F.timestamp_seconds(F.col("day") * 86400).alias("retrieved_at"), F.lit("run").alias("run_id"), F.concat(F.lit("k"), "content_sha256").alias("resource_key"),
        F.lit(1).cast("long").alias("size_bytes"), F.lit("zip").alias("media_type"), F.lit("p").alias("storage_path"),
    )


def outcome(df):
    return sorted((r.retrieval_id, r.content_sha256, r.is_new) for r in df.collect())


def test_outcome_stays_true_when_blocks_are_lost(spark, tmp_path):
    raw, log = str(tmp_path / "raw"), str(tmp_path / "log")
    a = ingest_batch(landed(spark, ("r1", "h", 1), ("r2", "h", 2), ("r3", "g", 1)), raw, log)
    want = [("r1", "h", True), ("r2", "h", False), ("r3", "g", True)]
    assert outcome(a) == want
    b = ingest_batch(landed(spark, ("r4", "h", 3), ("r5", "n", 3)), raw, log)
    spark.catalog.clearCache()
    for rdd in spark.sparkContext._jsc.getPersistentRDDs().values():
        rdd.unpersist(True)
    assert outcome(a) == want and outcome(b) == [("r4", "h", False), ("r5", "n", True)]
    assert outcome(ingest_batch(landed(spark, ("r3", "g", 1), ("r2", "h", 2), ("r1", "h", 1)), raw, log)) == want  # a repeat: what is on record
    assert spark.read.parquet(raw).count() == 3 and spark.read.parquet(log).count() == 5


def test_a_batch_killed_between_any_two_writes_ends_the_same(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    first, second = landed(spark, ("r1", "h", 1), ("r2", "g", 1)), landed(spark, ("r3", "h", 2), ("r4", "n", 2), ("r5", "n", 3))
    want, whole, n = [("r3", "h", False), ("r4", "n", True), ("r5", "n", False)], DataFrameWriter.parquet, 0
    while True:
        raw, log, left = str(tmp_path / f"raw{n}"), str(tmp_path / f"log{n}"), [n]
        ingest_batch(first, raw, log)

        def parquet(self, path, *a, left=left, **k):
            if left[0] == 0:
                raise RuntimeError("killed")
            left[0] -= 1
            return whole(self, path, *a, **k)

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        try:
            ingest_batch(second, raw, log)
            ended = True
        except RuntimeError:
            ended = False
        monkeypatch.undo()
        assert outcome(ingest_batch(second, raw, log)) == want
        assert sorted(r[0] for r in spark.read.parquet(raw).select("content_sha256").collect()) == ["g", "h", "n"]
        assert sorted(r[0] for r in spark.read.parquet(log).select("retrieval_id").collect()) == ["r1", "r2", "r3", "r4", "r5"]
        if ended:
            break
        n += 1
    assert n >= 6


def test_an_append_shuffles_its_rows_once(spark, tmp_path, monkeypatch):
    """Rows were dealt to find the first of a key, to find those that are stored, and to be written."""
    path, plans = str(tmp_path / "t"), []
    batch = rows(spark, [(f"k{i}", f"{i % 4}a") for i in range(400)] + [("k1", "1a"), (None, "1a")])
    assert append_new(batch, path, "id", prune="sha") == 401
    frame = type(batch)
    observe = frame.observe
    monkeypatch.setattr(frame, "observe", lambda self, *a: (plans.append(self._jdf.queryExecution().executedPlan().toString()), observe(self, *a))[1])
    assert append_new(batch.unionByName(rows(spark, [("new", "2a")])), path, "id", prune="sha") == 2
    assert plans[0].count("Exchange") == 1 and "Join" not in plans[0]
