"""Archives read member by member, audits that go on from the last one, streams with state, and counts from the job that writes."""

from __future__ import annotations

import hashlib
import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F
from test_engine import archive, documents, restatement

from factlake.operators.quality import loss_totals, quality_report
from factlake.plans.build import build
from factlake.sources import archives, sinks
from factlake.sources.archives import audit_documents, central_directory, explode_members, list_members, stream_members
from factlake.streaming.ingest import start_registration, stream_documents


def stored(tmp_path, *contents):
    rows = []
    for c in contents:
        sha = hashlib.sha256(c).hexdigest()
        folder = tmp_path / sha[:2]
        folder.mkdir(exist_ok=True)
        (folder / f"{sha}.zip").write_bytes(c)
        rows.append((f"file:{folder}/{sha}.zip", sha))
    return rows


def test_members_stream_to_the_same_cells(spark, tmp_path):
    contents = [(2023, archive(2023, [("2023-12-31", 1, "2024-02-20", "1")], [{"VL_CONTA": str(i)} for i in range(700)])), (2024, archive(2024, [], [{"DS_CONTA": "a;\nb"}], "BPA_ind"))]
    docs = spark.createDataFrame(stored(tmp_path, *[c for _, c in contents]), "path string, content_sha256 string")
    want = explode_members(list_members(documents(spark, *contents)))
    members = central_directory(docs)
    got = stream_members(members)
    cells = lambda df: sorted((r.content_sha256, r.member, r.line_no, sorted(r.cells.items())) for r in df.collect())
    assert members.count() == 4 and cells(got) == cells(want)
    assert {r.member for r in central_directory(docs, ["BPA"]).collect()} == {"dfp_cia_aberta_2023.csv", "dfp_cia_aberta_2024.csv", "dfp_cia_aberta_BPA_ind_2024.csv"}


def test_one_archive_with_many_members_uses_many_tasks(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for year in range(2000, 2040):
            z.writestr(f"dfp_cia_aberta_DRE_con_{year}.csv", "A;B\r\n1;2\r\n")
    docs = spark.createDataFrame([(str(path), hashlib.sha256(path.read_bytes()).hexdigest())], "path string, content_sha256 string")
    tasks = stream_members(central_directory(docs)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_large_member_leaves_in_batches(tmp_path):
    path, name = tmp_path / "a.zip", "dfp_cia_aberta_DRE_con_2020.csv"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "A;B\r\n" + f"{'x' * 1000};2\r\n" * 60_000)
    n, most = 0, 0
    tracemalloc.start()
    for rows in archives._record_batches("s", str(path), name):
        n, most = n + len(rows), max(most, len(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and most <= archives._ROWS and peak < 30e6  # 60 MB unpacked


def test_an_archive_with_other_bytes_is_an_error(spark, tmp_path):
    ((path, sha),) = stored(tmp_path, archive(2023, [], [{}]))
    with open(path.removeprefix("file:"), "ab") as f:
        f.write(b"!")
    with pytest.raises(Exception, match=f"does not match its hash: {sha}"):
        central_directory(spark.createDataFrame([(path, sha)], "path string, content_sha256 string")).count()


def test_a_build_by_path_is_that_by_content(spark, tmp_path):
    docs = restatement(spark)
    paths = spark.createDataFrame(stored(tmp_path, *[bytes(r.content) for r in docs.collect()]), "path string, content_sha256 string")
    one, two = build(docs, "r", str(tmp_path / "a")), build(docs.drop("content").join(paths, "content_sha256"), "r", str(tmp_path / "b"))
    for a, b in ((one.silver, two.silver), (one.gold, two.gold)):
        assert a.count() == 4 and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    with pytest.raises(ValueError, match="no documents"):
        build(docs.drop("content").join(paths, "content_sha256").limit(0), "r", str(tmp_path / "c"))


def test_an_audit_reads_changed_folders_only(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    rows = stored(tmp_path / "in", *[f"content {i}".encode() for i in range(40)])
    audits, root, read = str(tmp_path / "audits"), str(tmp_path / "in"), []
    scan = archives.scan_documents
    monkeypatch.setattr(archives, "scan_documents", lambda s, p, g="*", folders=None: (read.append(sorted(f.rsplit("/", 1)[-1] for f in folders)), scan(s, p, g, folders))[1])
    assert audit_documents(spark, root, audits).count() == 0 and len(read[-1]) == len(os.listdir(root))
    n = len(read)
    assert audit_documents(spark, root, audits).count() == 0 and len(read) == n  # nothing is read
    bad = rows[3][0].removeprefix("file:")
    with open(bad, "r+b") as f:
        f.write(b"X")
    os.utime(bad, (2_000_000_000, 2_000_000_000))
    (r,) = audit_documents(spark, root, audits).collect()
    assert read[-1] == [rows[3][1][:2]] and r.wrong[0].endswith(bad)
    assert [x.wrong for x in audit_documents(spark, root, audits).collect()] == [r.wrong]  # wrong until mended
    with open(bad, "r+b") as f:
        f.write(b"c")
    assert audit_documents(spark, root, audits).count() == 0
    more = stored(tmp_path / "in", b"one more")
    assert audit_documents(spark, root, audits).count() == 0 and read[-1] == [more[0][1][:2]]
    audit_documents(spark, root, audits, full=True)
    assert len(read[-1]) == len(os.listdir(root))


def test_the_build_counts_as_it_writes(spark, tmp_path):
    rows = [{}, {"CD_CVM": "ABC"}, {"CD_CVM": "5"}, {"DT_REFER": "2023-1-5"}, {"VL_CONTA": ""}, {"MOEDA": "DOLAR"}]
    built = build(documents(spark, (2023, archive(2023, [("2023-12-31", 1, "2024-02-20", "1")], rows))), "r", str(tmp_path / "w"), companies=[14826])
    assert "FileScan" not in built.report()._jdf.queryExecution().executedPlan().toString()
    for stage, table in (("silver", built.typed), ("gold", built.facts)):
        assert {r.reason: r["rows"] for r in built.report().where(F.col("stage") == stage).collect()} == {r.reason: r["rows"] for r in quality_report(table).collect()}
        assert built.totals().where(F.col("stage") == stage).select("read", "emitted", "lost", "filtered").collect() == loss_totals(table).collect()
    assert built.counts["gold"]["unknown_currency"] == 1 and build(restatement(spark), "r", str(tmp_path / "v")).counts["silver"]["ok"] == 4


def test_a_stream_reads_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    source, table, checkpoint, read = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c"), []
    source.mkdir()
    whole = sinks.candidate_files
    monkeypatch.setattr(sinks, "candidate_files", lambda *a: (lambda out: (read.append(len(out[0])), out)[1])(whole(*a)))

    def run(at=checkpoint):
        q = start_registration(stream_documents(spark, str(source)), table, at)
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(table).count()

    for n in range(3):
        for i in range(4):
            (source / f"{n}-{i}.zip").write_bytes(f"{n} {i // 2}".encode())
        os.utime(source / f"{n}-0.zip", (1_000_000_000 - n, 1_000_000_000 - n))  # old files are not late
        assert run() == 2 * (n + 1)
    assert read and max(read) == 0  # new contents: no file is opened
    (source / "again.zip").write_bytes(b"0 0")
    assert run() == 6 and max(read) == 0  # known to the state: it does not come to the table
    assert run() == 6
    assert run(str(tmp_path / "c2")) == 6 and max(read) >= 1  # another stream, without state: found by the index
