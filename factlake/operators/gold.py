"""Silver rows to bitemporal facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..schemas import GOLD_COLUMNS


def gold_reason(scale: Column, currency: Column, start: Column, end: Column, knowledge: Column, cnpj: Column, value: Column) -> Column:
    """The first rule that a row breaks, or null."""
    return (
        F.when(X.scale_factor(scale).isNull(), "unknown_scale").when(X.currency(currency).isNull(), "unknown_currency").when(X.period_type(start, end).isNull(), "irregular_period")
        .when((knowledge < end) | X.entity_id(cnpj).isNull() | X.scaled(value, scale).isNull(), "contract_violation")
    )


def to_facts(silver: DataFrame) -> DataFrame:
    """The 26 gold columns plus skip_reason; rows without a reason are facts."""
    s = F.col
    reason = gold_reason(s("escala_moeda"), s("moeda"), s("dt_ini_exerc"), s("dt_fim_exerc"), s("dt_receb"), s("cnpj"), s("vl_conta"))
    return silver.select(
        "*", s("silver_id").alias("fact_id"), X.entity_id(s("cnpj")).alias("entity_id"), X.period_type(s("dt_ini_exerc"), s("dt_fim_exerc")).alias("period_type"),
        s("dt_ini_exerc").alias("period_start"), s("dt_fim_exerc").alias("period_end"), s("dt_receb").alias("knowledge_date"), X.scaled(s("vl_conta"), s("escala_moeda")).alias("value"),
        X.currency(s("moeda")).alias("unit"), X.currency(s("moeda")).alias("currency"), s("doc_id").alias("source_doc_id"), s("versao").alias("source_doc_version"),
        X.locator(s("source_member"), s("source_line_no"), s("cd_conta"), s("coluna_df")).alias("locator"), X.metric(s("statement"), s("cd_conta"), s("coluna_df")).alias("metric"), reason.alias("skip_reason"),
    ).select(*GOLD_COLUMNS, "metric", "skip_reason")


def contract_violations(facts: DataFrame) -> DataFrame:
    """facts with a boolean per broken rule of a fact's period."""
    start, end = F.col("period_start"), F.col("period_end")
    return facts.withColumns({
        "known_too_early": F.col("knowledge_date") < end,
        "instant_with_start": (F.col("period_type") == "instant") & start.isNotNull(),
        "flow_without_start": (F.col("period_type") != "instant") & start.isNull(),
        "reversed_period": F.coalesce(start > end, F.lit(False)),
    })
