"""Restatements: values of one period that changed between their first and last known version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..schemas import FACT_KEY, VERSION_ORDER


def fact_filter(facts: DataFrame, cod_cvm: int | None = None, cd_conta: str | None = None, statement: str | None = None, consolidated: bool | None = None) -> DataFrame:
    """Conjunction of the given conditions; None is no condition."""
    for name, value in (("cod_cvm", cod_cvm), ("cd_conta", cd_conta), ("statement", statement), ("consolidated", consolidated)):
        if value is not None:
            facts = facts.where(F.col(name) == value)
    return facts


def restatements(facts: DataFrame, min_abs_pct: float | None = None, key: list[str] = FACT_KEY, **conditions) -> DataFrame:
    """Per restated key: original, revised (structs), delta, delta_pct. One shuffle; first and last version are partial aggregates."""
    version = F.struct(*VERSION_ORDER, *[c for c in facts.columns if c not in VERSION_ORDER])
    ends = fact_filter(facts, **conditions).groupBy(*key).agg(F.min(version).alias("original"), F.max(version).alias("revised"))
    o, r = F.col("original.value"), F.col("revised.value")
    out = ends.where(o != r)
    if min_abs_pct is not None:
        out = out.where(X.at_least_pct(o, r, min_abs_pct))
    return out.withColumns({"delta": X.delta(o, r), "delta_pct": X.delta_pct(o, r)})


def unstable_keys(facts: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """Keys that ever had two values, back and forth included."""
    return facts.groupBy(*key).agg(F.count(F.lit(1)).alias("versions"), F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")


def flag_restatements(facts: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """facts with is_restatement: one known on an earlier day has another value."""
    before = Window.partitionBy(*key).orderBy(F.datediff(VERSION_ORDER[0], F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("is_restatement", F.coalesce((F.min("value").over(before) != F.col("value")) | (F.max("value").over(before) != F.col("value")), F.lit(False)))
