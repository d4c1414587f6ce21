"""Reports on rejected rows and audits of table constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Reasons that are a user's choice and no loss.
NOT_LOSSES = ["filtered_out"]


def quality_report(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows per reason ('ok' for none), per group."""
    return rows.groupBy(*by, F.coalesce("skip_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def write_counted(rows: DataFrame, path: str, reasons: list[str]) -> dict[str, int]:
    """Writes rows (with skip_reason) and counts them by reason ('ok' for none) in the same job."""
    seen = Observation("reasons")
    counts = [F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("skip_reason") == r).alias(r) for r in reasons], F.count_if(F.col("skip_reason").isNull()).alias("ok")]
    rows.observe(seen, *counts).write.parquet(path)
    found = dict(seen.get)
    if found.pop("all") != sum(found.values()):
        raise ValueError(f"rows with a reason other than {', '.join(reasons)}")
    return {r: found[r] for r in ["ok", *reasons]}


def loss_totals(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per group: read, emitted, lost (filtered rows are no loss), filtered."""
    r = F.col("skip_reason")
    filtered = r.isin(NOT_LOSSES)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("read"), F.count(F.when(r.isNull(), 1)).alias("emitted"), F.count(F.when(r.isNotNull() & ~filtered, 1)).alias("lost"), F.count(F.when(filtered, 1)).alias("filtered")
    )


def report_rollup(rows: DataFrame, by: str) -> DataFrame:
    """loss_totals per value of by and, with a null, for all."""
    r = F.col("skip_reason")
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("read"), F.count(F.when(r.isNull(), 1)).alias("emitted"), F.count(F.when(r.isNotNull() & ~r.isin(NOT_LOSSES), 1)).alias("lost"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def counts_where(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """name, rows: table_counts of tables that are the rows of one table under a condition each, read once."""
    one = rows.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(conditions.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("rows")) for i, name in enumerate(conditions)])).alias("x")).select("x.name", "x.rows")


def audit_constraints(rows: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """rules: name to SQL condition that must hold. A row (key, rule) per broken rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


#: Rules of the tables' columns.
DOCUMENT_RULES = {"sha256": "content_sha256 rlike '^[0-9a-f]{64}$'", "size": "size_bytes >= 0"}
SILVER_RULES = {"sha256": "content_sha256 rlike '^[0-9a-f]{64}$'", "line": "source_line_no >= 2", "version": "versao >= 1"}
