"""Percent limits and deltas of values of any size against Python's Decimal."""

from __future__ import annotations

import functools
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from factlake.functions import expr as X
from factlake.schemas import VALUE


@functools.cache
def pairs():
    r, out = random.Random(3), []
    with localcontext(prec=60):
        for size in (1, 5, 12, 18, 19, 22, 26, 27, 28):
            for _ in range(12):
                o = Decimal(r.choice([-1, 1]) * r.randrange(10 ** (size - 1), 10**size)) + Decimal(r.randrange(10**10)).scaleb(-10)
                for d in (Decimal(1).scaleb(-10), o / 2, -o * 2, o * r.randrange(1, 300) / 100, Decimal(r.randrange(10**9))):
                    revised = (o + d).quantize(Decimal(1).scaleb(-10))
                    if abs(revised) < Decimal(10) ** 28:
                        out.append((o, revised))
        out += [(Decimal(10**19), Decimal("14999999999999999999")), (Decimal(10**19), Decimal("15000000000000000000")), (Decimal(0), Decimal(1)), (Decimal("1e-10"), Decimal("2e-10")), (Decimal("-" + "9" * 28), Decimal("9" * 28)), (None, Decimal(1)), (Decimal(1), None)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs())], f"i int, o {VALUE}, r {VALUE}").repartition(2).cache()


@pytest.mark.parametrize("limit", ["0.000000001", "0.123456789", "50", "49.999999999", "50.000000001", "100", "200", "12345.678901234", "0.000000000000000001", "99999999999", "0"])
def test_limits_are_exact(table, limit):
    got = {r.i: r.x for r in table.select("i", X.at_least_pct(F.col("o"), F.col("r"), Decimal(limit)).alias("x")).collect()}
    with localcontext(prec=120):
        for i, (o, r) in enumerate(pairs()):
            want = None if o is None or r is None and o else o != 0 and abs(r - o) * 100 >= Decimal(limit) * abs(o)
            assert bool(got[i]) == bool(want), (o, r, limit)


def test_a_pair_at_every_limit_of_its_own(spark):
    """Limits that are met exactly, and by one unit of the last place not."""
    r = random.Random(5)
    for _ in range(12):
        with localcontext(prec=80):
            o = Decimal(r.randrange(10**17, 10**18)) * 10**9
            limit = Decimal(r.randrange(1, 10**9)).scaleb(-9)
            met = o + o * limit / 100
            rows = [(o, met), (o, met - Decimal(1).scaleb(-10)), (-o, -met), (o, o - (met - o)), (o, o - (met - o) + Decimal(1).scaleb(-10))]
            assert met == met.quantize(Decimal(1).scaleb(-10))
        df = spark.createDataFrame(rows, f"o {VALUE}, r {VALUE}").coalesce(1)
        assert [x[0] for x in df.select(X.at_least_pct(F.col("o"), F.col("r"), limit)).collect()] == [True, False, True, True, False]


def test_delta_pct_is_exact_below_ten_to_the_27th(table):
    got = {r.i: (r.d, r.p) for r in table.select("i", X.delta(F.col("o"), F.col("r")).alias("d"), X.delta_pct(F.col("o"), F.col("r")).alias("p")).collect()}
    n = 0
    with localcontext(prec=120):
        for i, (o, r) in enumerate(pairs()):
            if o and r is not None and abs(r - o) < Decimal(10) ** 27:
                want = ((r - o) * 100 / abs(o)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
                if abs(want) < Decimal(10) ** 32:
                    n += 1
                    assert got[i] == (r - o if abs(o) < Decimal(10) ** 27 and abs(r) < Decimal(10) ** 27 else got[i][0], want), (o, r)
    assert n > 300


def test_no_double_is_on_the_path(table):
    plan = table.select(X.at_least_pct(F.col("o"), F.col("r"), "0.123456789").alias("a"), X.delta_pct(F.col("o"), F.col("r")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "double" not in plan.lower()


@pytest.mark.parametrize("limit", ["1e21", "0.0000000000000000001"])
def test_limits_that_have_too_many_digits_are_errors(limit):
    with pytest.raises(ValueError):
        X.at_least_pct(F.lit(1), F.lit(2), limit)
