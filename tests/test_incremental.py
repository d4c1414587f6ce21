"""Tables kept up to date by batches equal those made from all facts, in any order of batches."""

from __future__ import annotations

import itertools
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from factlake.operators import asof, restate
from factlake.operators.incremental import merge_ends, merge_validity, read_restatements, read_validity
from factlake.schemas import VALUE

KEY = ["cod_cvm", "cd_conta"]


def facts(spark, n, seed):
    r = random.Random(seed)
    rows = [(f"f{i:03}", r.randint(1, 6), r.choice(["a", None]), date(2020, 1, 1) + timedelta(r.randint(0, 8)), r.randint(1, 2), Decimal(r.randint(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, f"fact_id string, cod_cvm int, cd_conta string, knowledge_date date, source_doc_version int, value {VALUE}")


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_batches_gives_the_same_table(spark, tmp_path, seed):
    whole = facts(spark, 80, seed)
    parts = [whole.where(F.pmod(F.xxhash64("fact_id", F.lit(seed)), F.lit(3)) == i) for i in range(3)]
    parts.append(parts[0])  # a batch that comes again
    order = random.Random(seed).choice(list(itertools.permutations(range(4))))
    intervals, ends = str(tmp_path / "v"), str(tmp_path / "e")
    for i in order:
        merge_validity(parts[i], intervals, KEY, buckets=4)
        merge_ends(parts[i], ends, KEY, buckets=4)
    assert same(asof.with_validity(whole, KEY), read_validity(spark, intervals, whole))
    got, want = read_restatements(spark, ends, whole, KEY), restate.restatements(whole, key=KEY)
    short = lambda df: df.select(*KEY, "original.fact_id", F.col("revised.fact_id").alias("last"), "delta", "delta_pct")
    assert want.count() > 0 and same(short(want), short(got))
    day = date(2020, 1, 5)
    assert same(asof.as_of(whole, day, KEY), asof.valid_at(read_validity(spark, intervals, whole), day))


def test_a_merge_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    path, whole = str(tmp_path / "v"), facts(spark, 60, 1)
    n = merge_validity(whole, path, KEY, "first", buckets=16)
    before = set(read_validity(spark, path, whole).inputFiles())
    one = whole.where("cod_cvm = 1 and cd_conta = 'a'").limit(1).withColumn("fact_id", F.lit("late")).withColumn("knowledge_date", F.lit(date(2019, 1, 1)))
    assert merge_validity(one, path, KEY, "second") == 1 < n
    table = read_validity(spark, path, whole)
    kept = before & set(table.inputFiles())
    assert len({f.split("bucket=")[1].split("/")[0] for f in kept}) == n - 1
    assert same(asof.with_validity(whole.unionByName(one), KEY), table)
    assert merge_validity(one, path, KEY, "second") == 0  # done already


def test_a_merge_that_is_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    path, whole = str(tmp_path / "v"), facts(spark, 60, 2)
    old, new = whole.where("source_doc_version = 1"), whole.where("source_doc_version = 2")
    merge_validity(old, path, KEY, "a", buckets=4)
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, p, *a, **k: (_ for _ in ()).throw(RuntimeError("killed")) if p.endswith("_log") else write(self, p, *a, **k))
    with pytest.raises(RuntimeError):
        merge_validity(new, path, KEY, "b")
    monkeypatch.undo()
    assert same(asof.with_validity(old, KEY), read_validity(spark, path, whole))
    merge_validity(new, path, KEY, "b")
    assert same(asof.with_validity(whole, KEY), read_validity(spark, path, whole))


def test_empty_batches_and_tables(spark, tmp_path):
    path, whole = str(tmp_path / "v"), facts(spark, 10, 3)
    assert read_validity(spark, path, whole).count() == 0
    assert merge_validity(whole.limit(0), path, KEY) == 0
    assert read_validity(spark, path, whole).count() == 0
    merge_validity(whole, path, KEY)
    merge_validity(whole.limit(0), path, KEY)
    assert same(asof.with_validity(whole, KEY), read_validity(spark, path, whole))


def test_a_batch_that_comes_again_rewrites_nothing(spark, tmp_path):
    whole = facts(spark, 80, 4)
    whole = whole.withColumn("fact_id", F.sha2("fact_id", 256))
    parts = [whole.where(F.pmod(F.xxhash64("fact_id"), F.lit(2)) == i).localCheckpoint() for i in range(2)]
    for merge, name in ((merge_validity, "v"), (merge_ends, "e")):
        path = str(tmp_path / name)
        assert merge(parts[0], path, KEY, buckets=4) > 0
        assert merge(parts[0], path, KEY, buckets=4) == 0
        assert merge(parts[1], path, KEY, buckets=4) > 0
    assert same(asof.with_validity(whole, KEY), read_validity(spark, str(tmp_path / "v"), whole))


@pytest.mark.parametrize("text", ["", "ab", "AB", "abc", "é|x", "00ff" * 16, None])
def test_packed_text_comes_back(spark, text):
    from factlake.functions import expr as X

    row = spark.createDataFrame([(text,)], "t string").select("t", X.packed(F.col("t")).alias("p")).select("t", X.unpacked(F.col("p")).alias("u"), F.octet_length("p").alias("n")).first()
    assert row.u == row.t == text
    assert text != "00ff" * 16 or row.n == 33
