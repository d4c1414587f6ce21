"""End to end on generated archives, and the traps of the bitemporal reads."""

from __future__ import annotations

import hashlib
import io
import zipfile
from datetime import date
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from factlake.functions import expr as X
from factlake.operators import asof, catalog, lineage, restate
from factlake.plans.build import build, write
from factlake.schemas import VALUE
from factlake.sources.archives import documents_from_sidecars, explode_members, list_members, require_index, scan_documents, scan_sidecars, verify_documents
from factlake.sources.sinks import current_runs, ingest_batch, log_run_event, read_table, run_log

INDEX = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;CATEG_DOC;ID_DOC;DT_RECEB;LINK_DOC"
FLOW = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;GRUPO_DFP;MOEDA;ESCALA_MOEDA;ORDEM_EXERC;DT_INI_EXERC;DT_FIM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA;ST_CONTA_FIXA"
CNPJ = "00.000.000/0001-91"


def archive(year, docs, rows, member="DRE_con"):
    """docs: (refer, version, received, id). rows: dicts over the flow columns."""
    base = {"CNPJ_CIA": CNPJ, "DT_REFER": f"{year}-12-31", "VERSAO": "1", "DENOM_CIA": "ACME S.A.", "CD_CVM": "014826", "GRUPO_DFP": "", "MOEDA": "REAL", "ESCALA_MOEDA": "MIL", "ORDEM_EXERC": "ÚLTIMO",
            "DT_INI_EXERC": f"{year}-01-01", "DT_FIM_EXERC": f"{year}-12-31", "CD_CONTA": "3.01", "DS_CONTA": "Receita; \"líquida\"", "VL_CONTA": "1000.0000000000", "ST_CONTA_FIXA": "S"}
    quote = lambda v: '"' + v.replace('"', '""') + '"' if ";" in v or '"' in v or "\n" in v else v
    flow = [FLOW] + [";".join(quote((base | r)[c]) for c in FLOW.split(";")) for r in rows]
    index = [INDEX] + [";".join([CNPJ, d[0], str(d[1]), "ACME S.A.", "014826", "DFP", d[3], d[2], "http://x"]) for d in docs]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"dfp_cia_aberta_{year}.csv", "\r\n".join(index).encode("latin-1"))
        z.writestr(f"dfp_cia_aberta_{member}_{year}.csv", "\r\n".join(flow).encode("latin-1"))
        z.writestr("readme.txt", b"x")
    return out.getvalue()


def documents(spark, *contents):
    rows = [(hashlib.sha256(c).hexdigest(), f"r{i}", y, bytearray(c)) for i, (y, c) in enumerate(contents)]
    return spark.createDataFrame(rows, "content_sha256 string, retrieval_id string, year int, content binary")


def restatement(spark):
    a = archive(2023, [("2023-12-31", 1, "2024-02-20", "1")], [{}, {"DT_INI_EXERC": "2022-01-01", "DT_FIM_EXERC": "2022-12-31", "VL_CONTA": "800"}])
    b = archive(2024, [("2024-12-31", 1, "2025-02-20", "2")], [{"VL_CONTA": "1100"}, {"DT_INI_EXERC": "2023-01-01", "DT_FIM_EXERC": "2023-12-31", "VL_CONTA": "900", "ORDEM_EXERC": "PENÚLTIMO"}])
    return documents(spark, (2023, a), (2024, b))


def test_restatement_end_to_end(spark, tmp_path):
    built = build(restatement(spark), "run1", str(tmp_path / "work"))
    paths = str(tmp_path / "silver"), str(tmp_path / "gold")
    assert write(built, *paths) == (4, 4)
    assert write(built, *paths) == (0, 0)
    gold = spark.read.parquet(paths[1])
    at = lambda d: {r.period_end: r.value for r in asof.as_of(gold, d).collect()}
    end = date(2023, 12, 31)
    assert at(date(2024, 6, 30))[end] == 1_000_000 and at(date(2025, 6, 30))[end] == 900_000
    assert end in at(date(2024, 2, 20)) and end not in at(date(2024, 2, 19))
    (r,) = restate.restatements(gold).collect()
    assert r.delta == -100_000 and r.delta_pct == -10 and r.original.knowledge_date == date(2024, 2, 20)
    assert restate.restatements(gold, min_abs_pct=10.01).count() == 0 and restate.restatements(gold, min_abs_pct=10, cod_cvm=14826).count() == 1
    report = {r.content_sha256: r for r in built.document_report().collect()}
    assert len(report) == 2 and all(r.members == [f"dfp_cia_aberta_DRE_con_{y}.csv"] for r, y in zip(sorted(report.values(), key=lambda r: r.members), (2023, 2024), strict=True))
    assert all((r.ambiguous_keys, r.silver_read, r.silver_emitted, r.silver_lost, r.gold_read, r.gold_emitted, r.gold_filtered) == (0, 2, 2, 0, 2, 2, 0) for r in report.values())
    row = gold.where("value = 1000000").first()
    assert row.entity_id == "br:cnpj:00000000000191" and row.ordem_exerc == "ULTIMO" and row.locator == "dfp_cia_aberta_DRE_con_2023.csv#L2:cd_conta=3.01" and row.ds_conta == 'Receita; "líquida"'
    assert lineage.with_locator_parts(gold.where("value = 1000000")).select("member", "line_no", "account", "column").first()[:] == ("dfp_cia_aberta_DRE_con_2023.csv", 2, "3.01", "")


def test_append_reads_its_own_folders(spark, tmp_path):
    from factlake.sources.sinks import PREFIX, append_new

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{i}", f"{i % 16:x}{i % 16:x}{i:02x}") for i in range(64)], "id string, sha string")
    assert append_new(rows, path, "id", prune="sha") == 64
    assert append_new(rows.where("sha like '00%'").unionByName(spark.createDataFrame([("new", "00ff"), ("new", "00ff")], rows.schema)), path, "id", prune="sha") == 1
    table = spark.read.parquet(path)
    assert table.count() == 65 and table.where(F.col(PREFIX) == "h00").count() == 5
    assert len(table.where(F.col(PREFIX) == "h00").inputFiles()) >= 1


def test_unbuilt_documents(spark):
    from factlake.plans.build import unbuilt

    docs = spark.createDataFrame([("a",), ("b",)], "content_sha256 string")
    log = spark.createDataFrame([("a", "1.1.0"), ("b", "1.0.0")], "content_sha256 string, extractor_version string")
    assert [r.content_sha256 for r in unbuilt(log, docs, "1.1.0").collect()] == ["b"]


def test_build_reads_archives_once(spark, tmp_path):
    """A file's content is used once, whatever is asked of the build afterwards."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    docs = restatement(spark)
    built = build(docs.mapInPandas(count, docs.schema), "run", str(tmp_path / "w"))
    assert seen.value == 2 * 2  # two documents: their names, and their bytes
    write(built, str(tmp_path / "s"), str(tmp_path / "g"))
    built.report().collect()
    built.document_report().collect()
    assert seen.value == 2 * 2


def test_build_refuses_what_it_cannot_read(spark, tmp_path):
    docs = restatement(spark)
    with pytest.raises(ValueError, match="no documents"):
        build(docs.limit(0), "r", str(tmp_path / "a"))
    with pytest.raises(Exception, match="does not match its hash: " + "0" * 64):
        build(docs.withColumn("content_sha256", F.lit("0" * 64)), "r", str(tmp_path / "b"))
    assert build(docs, "r", str(tmp_path / "c"), companies=[], statements=[]).silver.count() == 4


def test_every_silver_reason(spark, tmp_path):
    rows = [{}, {"CD_CVM": "ABC"}, {"CD_CVM": "²"}, {"CD_CVM": "5"}, {"DT_FIM_EXERC": "0000-00-00"}, {"DT_REFER": "2023-1-5"}, {"CNPJ_CIA": "-"}, {"VERSAO": "0"}, {"VERSAO": "2"}, {"DT_REFER": "2020-12-31"},
            {"VL_CONTA": ""}, {"VL_CONTA": "n/d"}, {"VL_CONTA": "NaN"}, {"VL_CONTA": " 1e3 "}]
    docs = [("2023-12-31", 1, "2024-02-20", "1"), ("2023-12-31", 1, "2024-02-20", "1"), ("2023-12-31", 2, "2024-02-20", "a"), ("2023-12-31", 2, "2024-02-21", "b")]
    built = build(documents(spark, (2023, archive(2023, docs, rows))), "r", str(tmp_path / "w"), companies=[14826])
    got = {r.skip_reason: r["count"] for r in built.silver_rejected.groupBy("skip_reason").count().collect()}
    assert got == {"bad_key": 4, "filtered_out": 1, "bad_date": 2, "ambiguous_index": 1, "no_index": 1, "bad_value": 3}
    assert [r.vl_conta for r in built.silver.orderBy("source_line_no").collect()] == [1000, 1000]
    assert {(r.stage, r.reason): r["rows"] for r in built.report().collect()}["silver", "ok"] == 2


def test_every_gold_reason(spark, tmp_path):
    rows = [{}, {"ESCALA_MOEDA": "MILHAO"}, {"MOEDA": "DOLAR"}, {"DT_INI_EXERC": "2023-10-01"}, {"DT_FIM_EXERC": "2024-12-31", "DT_INI_EXERC": "2024-01-01"}, {"CNPJ_CIA": "0.000.000/0001-91"}, {"ESCALA_MOEDA": "unidade"}, {"DT_INI_EXERC": ""}, {"VL_CONTA": "9" * 25}]
    a = archive(2023, [("2023-12-31", 1, "2024-02-20", "1")], rows)
    built = build(documents(spark, (2023, a)), "r", str(tmp_path / "w"))
    got = {r.skip_reason: r["count"] for r in built.gold_rejected.groupBy("skip_reason").count().collect()}
    assert got == {"unknown_scale": 1, "unknown_currency": 1, "irregular_period": 1, "contract_violation": 2}
    assert sorted((r.value, r.period_type) for r in built.gold.collect()) == [(1000, "year"), (1_000_000, "instant"), (1_000_000, "year")]


def facts(spark, rows):
    """rows: (id, account, knowledge, version, value)."""
    df = spark.createDataFrame([(i, 1, "DRE", True, a, "", date(2023, 12, 31), date.fromisoformat(k), v, Dec(x)) for i, a, k, v, x in rows],
                               f"fact_id string, cod_cvm int, statement string, consolidated boolean, cd_conta string, coluna_df string, period_end date, knowledge_date date, source_doc_version int, value {VALUE}")
    return df


def test_ties_and_back_and_forth(spark):
    f = facts(spark, [("b", "1", "2024-01-01", 1, "5"), ("a", "1", "2024-01-01", 1, "5"), ("c", "2", "2024-01-01", 1, "1"), ("d", "2", "2024-02-01", 1, "2"), ("e", "2", "2024-03-01", 1, "1"), ("g", "3", "2024-01-01", 1, "0"), ("h", "3", "2024-02-01", 1, "900")])
    assert {r.cd_conta: r.fact_id for r in asof.as_of(f, date(2024, 6, 1)).collect()} == {"1": "a", "2": "e", "3": "h"}
    assert [r.fact_id for r in asof.history(f).where("cd_conta = '1'").orderBy("version_no").collect()] == ["a", "b"]
    assert [(r.cd_conta, r.delta_pct) for r in restate.restatements(f).collect()] == [("3", None)]
    assert restate.restatements(f, min_abs_pct=0).count() == 0
    assert {r.cd_conta for r in restate.unstable_keys(f).collect()} == {"2", "3"}
    assert {r.fact_id: r.is_restatement for r in restate.flag_restatements(f).collect()} == {"a": False, "b": False, "c": False, "d": True, "e": True, "g": False, "h": True}
    probes = spark.createDataFrame([(1, "2", date(2024, 2, 15)), (2, "2", date(2023, 1, 1)), (3, "9", date(2024, 1, 1)), (4, "1", date(2024, 1, 1))], "n int, cd_conta string, as_of date")
    assert {r.n: r.fact and r.fact.fact_id for r in asof.asof_join(probes, f, ["cd_conta"]).collect()} == {1: "d", 2: None, 3: None, 4: "a"}
    spans = [(r.fact_id, r.valid_to) for r in asof.with_validity(f).where("cd_conta = '2'").orderBy("valid_from").collect()]
    assert spans == [("c", date(2024, 2, 1)), ("d", date(2024, 3, 1)), ("e", None)]
    assert asof.as_of(f.limit(0), date(2024, 1, 1)).count() == 0


def test_decimals_keep_their_places(spark):
    df = spark.createDataFrame([(Dec("0.0000000001"), Dec("123456789012345678901234567.0000000001"), "MIL")], f"a {VALUE}, b {VALUE}, s string")
    r = df.select(X.scaled(F.col("a"), F.col("s")).alias("x"), X.scaled(F.col("b"), F.col("s")).alias("y"), X.delta(F.col("a"), F.col("b")).alias("d")).first()
    assert r.x == Dec("0.0000001") and r.y is None and r.d == Dec("123456789012345678901234567")


def test_restatements_of_large_values_and_fine_limits(spark):
    big = [("1", "20000000000000000", "20000000000000001"), ("2", "1" + "0" * 20, "3" + "0" * 20), ("3", "9" * 28, "1"), ("4", "100000", "100001"), ("5", "-" + "9" * 28, "9" * 28)]
    f = facts(spark, [x for a, o, r in big for x in ((a + "o", a, "2024-01-01", 1, o), (a + "r", a, "2024-02-01", 1, r))])
    got = {r.cd_conta: (r.delta, r.delta_pct) for r in restate.restatements(f).collect()}
    assert got["1"] == (1, Dec("0.000000")) and got["2"] == (Dec("2" + "0" * 20), 200) and got["3"] == (Dec(1) - Dec("9" * 28), -100) and got["4"] == (1, Dec("0.001000"))
    assert got["5"][0] is None  # takes 29 digits
    passed = lambda p: {r.cd_conta for r in restate.restatements(f, min_abs_pct=p).collect()} - {"5"}
    assert passed(0.001) == {"2", "3", "4"} and passed(0.00101) == {"2", "3"} and passed(0.001001) == {"2", "3"} and passed(200) == {"2"} and passed(0) == {"1", "2", "3", "4"}


def test_upper_plain_folds_every_latin1_letter(spark):
    import unicodedata

    text = "".join(map(chr, range(0xA1, 0x100)))
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.upper()) if not unicodedata.combining(c))
    assert spark.createDataFrame([(text,)], "t string").select(X.upper_plain(F.col("t"))).first()[0] == plain


def test_clashing_names_stay(spark):
    f = facts(spark, [("a", "1", "2024-01-01", 1, "5"), ("b", "1", "2024-02-01", 1, "6")]).withColumns({"n": F.lit(7), "__n": F.lit(8)})
    for got in (asof.as_of(f, date(2024, 6, 1)), asof.with_validity(f)):
        assert got.columns[: len(f.columns)] == f.columns and {(r["n"], r["__n"]) for r in got.collect()} == {(7, 8)}


def test_run_log_from_start_to_finish(spark, tmp_path):
    path = str(tmp_path / "runs")
    log_run_event(spark, path, "a", "build", "running", code_version="1.0", git_sha="abc")
    log_run_event(spark, path, "a", "build", "success", "done")
    log_run_event(spark, path, "b", "fetch", "running")
    assert {r.run_id: r.status for r in current_runs(spark.read.parquet(path)).collect()} == {"a": "success", "b": "running"}
    a, b = run_log(spark.read.parquet(path)).orderBy("run_id").collect()
    assert (a.status, a.command, a.code_version, a.git_sha, a.notes) == ("success", "build", "1.0", "abc", "done") and a.started_at < a.finished_at and "spark" in a.runtime_version
    assert b.status == "running" and b.started_at and b.finished_at is None
    with pytest.raises(ValueError):
        log_run_event(spark, path, "c", "build", "over")


def test_strip_accents_is_complete_for_latin1(spark):
    import unicodedata

    text = "".join(map(chr, range(0x20, 0x100)))
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert spark.createDataFrame([(text,)], "t string").select(X.strip_accents(F.col("t"))).first()[0] == plain


def test_years():
    assert catalog.parse_years("2020-2022, 2024,", 2010, 2030) == [2020, 2021, 2022, 2024]
    for bad in ("2024-2020", "20x4", "", "1999", "2031"):
        with pytest.raises(ValueError):
            catalog.parse_years(bad, 2010, 2030)


def test_documents_and_sidecars(spark, tmp_path):
    good, bad = b"one", b"two"
    for content, name in ((good, hashlib.sha256(good).hexdigest()), (bad, "0" * 64)):
        (tmp_path / f"{name}.zip").write_bytes(content)
    checked = verify_documents(scan_documents(spark, str(tmp_path), "*.zip"))
    assert sorted(r.ok for r in checked.collect()) == [False, True]
    (tmp_path / "a.json").write_text('{"document": {"content_sha256": "x", "size_bytes": 3, "first_seen_at": "2024-01-02T00:00:00Z"}, "provenance": {"provider_id": "p", "http": {"status": 200}}}')
    assert documents_from_sidecars(scan_sidecars(spark, str(tmp_path))).first().size_bytes == 3


def test_missing_index_is_an_error(spark):
    docs = documents(spark, (2022, archive(2023, [], [{}])))
    with pytest.raises(ValueError):
        require_index(docs, list_members(docs))
    assert explode_members(list_members(docs, ["BPA"])).count() == 0


def test_ingest_registers_once_and_logs_always(spark, tmp_path):
    landed = spark.sql("select 'r1' retrieval_id, 'h' content_sha256, timestamp '2024-01-01' retrieved_at, 'run' run_id, 'k' resource_key, 1L size_bytes, 'zip' media_type, 'p' storage_path")
    raw, log = str(tmp_path / "raw"), str(tmp_path / "log")
    assert [r.is_new for r in ingest_batch(landed, raw, log).collect()] == [True]
    again = landed.withColumn("retrieval_id", F.lit("r2"))
    assert [r.is_new for r in ingest_batch(again, raw, log).collect()] == [False]
    assert spark.read.parquet(raw).count() == 1 and spark.read.parquet(log).count() == 2
    assert read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    runs = spark.sql("select * from values ('a', 'running', 1), ('a', 'success', 2) t(run_id, status, event_ts)")
    assert current_runs(runs).first().status == "success"


def test_stream_registers_each_content_once(spark, tmp_path):
    from factlake.streaming.ingest import start_registration, stream_documents

    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.zip").write_bytes(b"same")
    q = start_registration(stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
