"""As-of joins of hot keys, panels of many dates and incremental tables against brute force."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factlake.operators import asof
from factlake.schemas import VALUE

KEY = ["cod_cvm", "cd_conta"]
DAY0 = date(2020, 1, 1)


def made(spark, n, seed=1, keys=3, days=400):
    """n facts, half of them of one key, with ties in day and version."""
    r = random.Random(seed)
    rows = [(f"f{i:05}", 1 if r.random() < 0.5 else r.randint(2, 1 + keys), "a", DAY0 + timedelta(r.randint(0, days)), r.randint(1, 3), Decimal(i)) for i in range(n)]
    return spark.createDataFrame(rows, f"fact_id string, cod_cvm int, cd_conta string, knowledge_date date, source_doc_version int, value {VALUE}"), rows


def known(rows, key, day):
    found = [x for x in rows if (x[1], x[2]) == key and x[3] <= day]
    return min(found, key=lambda x: (-x[3].toordinal(), -x[4], x[0]), default=None)


@pytest.mark.parametrize("limit", [asof.ROWS_PER_TASK, 50])
def test_asof_join_of_a_hot_key(spark, limit):
    facts, rows = made(spark, 900)
    r = random.Random(2)
    asked = [(i, r.choice([1, 1, 1, 2, 3, 4, 9]), "a", DAY0 + timedelta(r.randint(-5, 420)), "x", i) for i in range(500)] + [(501, None, "a", DAY0, "x", 1), (502, 1, "a", None, "x", 1)]
    probes = spark.createDataFrame(asked, "n int, cod_cvm int, cd_conta string, as_of date, fact string, part int")
    facts = facts.unionByName(spark.createDataFrame([("zz", None, "a", DAY0, 1, None), ("zy", 1, "a", None, 1, None)], facts.schema))
    out = asof.asof_join(probes, facts, KEY, rows_per_task=limit)
    assert out.columns == [*KEY, "as_of", "n", "fact", "part", "fact_"]
    got = {x.n: x for x in out.collect()}
    assert len(got) == len(asked)
    for n, cod, conta, day, *_ in asked:
        want = cod and day and known(rows, (cod, conta), day)
        assert (got[n].fact_ and got[n].fact_.fact_id) == (want and want[0]), n
        assert got[n].fact == "x"


def test_a_hot_key_is_dealt_over_all_tasks(spark):
    facts, _ = made(spark, 4000, keys=1)
    probes = facts.where("cod_cvm = 1").select(*KEY, F.col("knowledge_date").alias("as_of"))
    out = asof.asof_join(probes, facts, KEY, rows_per_task=100)
    per_task = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(per_task) == probes.count() and n > 1
    assert len(ranges) > 1 and max(r.n for r in ranges) < 0.8 * probes.count()


def test_panel_of_many_days_is_no_grid(spark):
    facts, rows = made(spark, 300)
    days = [DAY0 + timedelta(i) for i in range(-3, 2000, 1)]
    out = asof.as_of_panel(facts, [*days, days[0]], KEY)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1
    r = random.Random(4)
    picked = r.sample(days, 15)
    got = {(x.cod_cvm, x.as_of): x.fact_id for x in out.where(F.col("as_of").isin(picked)).collect()}
    for cod in (1, 2, 3, 4, 5):
        for d in picked:
            want = known(rows, (cod, "a"), d)
            assert got.get((cod, d)) == (want and want[0])
    assert asof.as_of_panel(facts, [], KEY).count() == 0
    with_date = facts.withColumns({"since": F.lit(1), "days": F.lit(2)})
    assert asof.as_of_panel(with_date, [DAY0], KEY).columns == ["as_of", *with_date.columns]


def test_intervals_answer_every_day(spark):
    facts, _ = made(spark, 400)
    spans = asof.with_validity(facts, KEY)
    for n in (-1, 0, 77, 400, 900):
        day = DAY0 + timedelta(n)
        assert sorted(asof.valid_at(spans, day).collect()) == sorted(asof.as_of(facts, day, KEY).collect())
