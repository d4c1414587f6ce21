"""Queries on keys and rows as they are in larger tables."""

from __future__ import annotations

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from factlake.operators import asof, silver
from factlake.plans import driver_tables as D
from factlake.plans import oracles, queries
from factlake.sources import layout

SF = "/root/testdata/sf0.001"


def test_large_deltas_of_long_part_keys(spark, tmp_path):
    parts = [1, 19_999, 99_999, 999_999, 1_000_000, 7_200_000, 123_456_789]
    rows = [(1, p, 1, n, 10.0, 1234.5 + n, 0.0, 0.0, "A", "O", dt.datetime(1996, 1, 2)) for p in parts for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "O", 1.0, dt.datetime(1996, 1, 1), "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(oracles.ORACLES["large_deltas"]).fetchall()
    assert sorted(map(tuple, queries.large_deltas(spark, str(tmp_path)).collect())) == sorted(want)


def test_typed_cells_run_in_compiled_methods_and_without_a_map(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    plan = queries.silver_typed_projection(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan
    assert int(spark.conf.get(limit)) <= 8000


def test_cells_may_be_a_struct_or_a_map(spark):
    details = D.details(spark, SF).cache()
    names = details.schema["cells"].dataType.names
    maps = details.withColumn("cells", F.create_map(*[x for n in names for x in (F.lit(n), F.col("cells")[n])]))
    one, two = silver.typed_cells(details), silver.typed_cells(maps)
    assert one.count() == two.count() > 0 and one.exceptAll(two).isEmpty()


def test_small_files_need_no_more_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/laid"
    facts = spark.range(4_000).select(F.col("id").cast("string").alias("fact_id"), (F.col("id") % 50).alias("k"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 300).cast("int")).alias("knowledge_date"), F.lit(1).alias("source_doc_version"))
    written = [layout.lay_out(facts.where(F.col("id") % 2 == i), path, ["k"], rows_per_file=20) for i in (0, 1)]
    files = spark.read.schema(facts.schema).parquet(path).inputFiles()
    assert len(files) == sum(written) >= 200
    assert len({f.rsplit("/", 1)[-1].split("-")[1] for f in files}) <= spark.sparkContext.defaultParallelism
    assert layout.read_laid_out(spark, path, facts.schema, {"k": 7}).count() == 80
    assert len(layout.files_for(spark, path, facts.schema, {"k": 7})) < len(files)


def test_facts_of_the_older_version_are_typed_once(spark):
    plan = queries.all_versions_union(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 1


def test_a_hot_keys_facts_of_one_day_are_one_row(spark, monkeypatch):
    facts = spark.range(6_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("fact_id"), F.lit("a").alias("k"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 10).cast("int")).alias("knowledge_date"), (F.col("id") % 3).cast("int").alias("source_doc_version"))
    probes = spark.range(300).select("id", F.lit("a").alias("k"), F.date_add(F.lit(dt.date(1999, 12, 30)), (F.col("id") % 15).cast("int")).alias("as_of"))
    kept = {}
    monkeypatch.setattr(asof, "written", lambda df, name, write=asof.written: kept.setdefault(name, write(df, name)))
    got = {r.id: r.fact and r.fact.fact_id for r in asof.asof_join(probes, facts, ["k"], rows_per_task=100).collect()}
    assert kept["asof"].count() == 300 + 10
    best = {day: min((n for n in range(6_000) if n % 10 == day), key=lambda n: (-(n % 3), n)) for day in range(10)}
    assert got == {i: f"{best[min(i % 15 - 2, 9)]:05}" if i % 15 >= 2 else None for i in range(300)}


def test_both_counts_read_their_rows_once(spark):
    plan = queries.table_counts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_linenumber" in x for x in plan.splitlines()) == 1


def test_facts_are_dealt_by_key_before_their_ids_are_made(spark):
    for query in (queries.restatements_all, queries.restatements_min_pct, queries.version_deltas, queries.restatement_flag):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        exchange = plan.index("Exchange hashpartitioning(cod_cvm")
        assert plan.count("Exchange hashpartitioning(cod_cvm") == 1 and "sha2(" in plan[:exchange] and "sha2(" not in plan[exchange:], query.__name__


def test_documents_meet_the_index_before_their_lines(spark):
    for query in (queries.loss_totals, queries.report_rollup, queries.gold_scale_currency_period, queries.detail_index_join, queries.all_versions_union):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        lines_in = [i for i, x in enumerate(plan) if "Relation" in x and "l_linenumber" in x]
        index_in = [i for i, x in enumerate(plan) if "Join LeftOuter" in x and "dt_refer" in x]
        assert len(lines_in) == len(index_in) == 1 and lines_in[0] < index_in[0], query.__name__


def test_entries_by_document_or_by_row_give_the_same_rows(spark):
    by_row = silver.to_silver(D.details(spark, SF), D.index(spark, SF), "r").cache()
    by_document = silver.to_silver(D.details(spark, SF, D.index(spark, SF)), None, "r").cache()
    assert by_row.schema.names == by_document.schema.names and by_row.count() == by_document.count() > 0
    assert by_row.exceptAll(by_document).isEmpty() and {"ambiguous_index", "no_index"} <= {r[0] for r in by_document.select("skip_reason").distinct().collect()}
