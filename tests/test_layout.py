"""Facts laid out by interleaved bits: few files are opened, and no row is lost."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from factlake.operators import asof
from factlake.sources.layout import BOXES, files_for, interleaved, lay_out, read_laid_out

KEY = ["cod_cvm", "cd_conta"]


def facts(spark, n=6000, seed=1):
    r = random.Random(seed)
    rows = [(f"f{i:05}", r.randint(1, 80), r.choice("ab"), date(2010, 1, 1) + timedelta(r.randint(0, 3600)), 1, i) for i in range(n)]
    return spark.createDataFrame(rows, "fact_id string, cod_cvm int, cd_conta string, knowledge_date date, source_doc_version int, value int")


def ids(df):
    return sorted(r.fact_id for r in df.select("fact_id").collect())


def test_bits_are_interleaved(spark):
    df = spark.createDataFrame([(0b1011, 0b0110), (65535, 0), (0, 65535)], "x int, y int")
    assert [r[0] for r in df.select(interleaved(F.col("x"), F.col("y"))).collect()] == [0b10011110, 0xAAAAAAAA, 0x55555555]


def test_a_read_of_one_key_and_day_opens_few_files(spark, tmp_path):
    path, rows = str(tmp_path / "t"), facts(spark)
    n = lay_out(rows, path, KEY, rows_per_file=100)
    assert n >= 48
    key, day = {"cod_cvm": 7, "cd_conta": "a"}, date(2014, 6, 30)
    one_day = files_for(spark, path, rows.schema, key, day, day)
    known = files_for(spark, path, rows.schema, key, until=day)
    assert len(one_day) <= 3 and len(known) <= n / 4
    got = read_laid_out(spark, path, rows.schema, key, until=day)
    assert set(got.inputFiles()) == set(known)
    of_key = rows.where("cod_cvm = 7 and cd_conta = 'a'")
    assert ids(got) == ids(of_key.where(F.col("knowledge_date") <= F.lit(day)))
    assert ids(asof.as_of(got, day, KEY)) == ids(asof.as_of(of_key, day, KEY))
    assert ids(read_laid_out(spark, path, rows.schema)) == ids(rows)
    assert ids(read_laid_out(spark, path, rows.schema, since=day, until=day)) == ids(rows.where(F.col("knowledge_date") == F.lit(day)))
    assert read_laid_out(spark, path, rows.schema, {"cod_cvm": None, "cd_conta": "a"}).count() == 0


def test_appends_and_files_without_a_box(spark, tmp_path):
    path, rows = str(tmp_path / "t"), facts(spark, 500)
    assert read_laid_out(spark, path, rows.schema, {"cod_cvm": 1, "cd_conta": "a"}).count() == 0
    lay_out(rows.where("value < 300"), path, KEY, rows_per_file=100)
    lay_out(rows.where("value >= 300"), path, KEY, rows_per_file=100)
    lay_out(rows.limit(0), path, KEY)
    late = rows.limit(1).withColumns({"fact_id": F.lit("late"), "knowledge_date": F.lit(None).cast("date")})
    late.write.mode("append").parquet(path)  # cut off before its box
    assert spark.read.parquet(f"{path}/{BOXES}").agg(F.sum("rows")).first()[0] == 500
    assert ids(read_laid_out(spark, path, rows.schema)) == sorted([*ids(rows), "late"])
    for cod in (1, 40, 80):
        key = {"cod_cvm": cod, "cd_conta": "b"}
        assert ids(read_laid_out(spark, path, rows.schema, key, until=date(2030, 1, 1))) == ids(rows.where(f"cod_cvm = {cod} and cd_conta = 'b'"))
