"""Text cells to typed silver rows; every rejected row has one reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..schemas import EXTRACTOR, EXTRACTOR_VERSION, SILVER_COLUMNS

def cell(name: str) -> Column:
    return F.col("cells")[name]


def index_entries(cells: DataFrame, document: list[str] = ("content_sha256",)) -> DataFrame:
    """Usable index rows: document, cnpj, dt_refer, versao, doc_id, dt_receb, link_doc."""
    rows = cells.select(
        *document, X.digits(cell("CNPJ_CIA")).alias("cnpj"), X.iso_date(cell("DT_REFER")).alias("dt_refer"), X.digits_int(cell("VERSAO")).alias("versao"),
        X.trimmed(cell("ID_DOC")).alias("doc_id"), X.iso_date(cell("DT_RECEB")).alias("dt_receb"), X.blank_to_null(cell("LINK_DOC")).alias("link_doc"),
    )
    return rows.where("cnpj <> '' and dt_refer is not null and versao is not null and dt_receb is not null")


def document_index(entries: DataFrame, key: list[str] = ("content_sha256", "cnpj", "dt_refer", "versao")) -> DataFrame:
    """One row per key. Equal entries are one; keys with different entries are ambiguous and have none."""
    entry = F.struct("doc_id", "dt_receb", "link_doc")
    grouped = entries.groupBy(*key).agg(F.min(entry).alias("e"), F.max(entry).alias("f"))
    same = F.col("e").eqNullSafe(F.col("f"))
    # min and max differ if and only if there are two entries
    return grouped.select(*key, (~same).alias("is_ambiguous"), *[F.when(same, F.col(f"e.{c}")).alias(c) for c in ("doc_id", "dt_receb", "link_doc")])


#: What a document's rows share: the typed key and what the index holds of it.
ENTRY = ["cnpj", "dt_refer", "versao", "is_ambiguous", "doc_id", "dt_receb", "link_doc"]


def _typed_key() -> dict[str, Column]:
    return {"cnpj": X.digits(cell("CNPJ_CIA")), "dt_refer": X.iso_date(cell("DT_REFER")), "versao": X.digits_int(cell("VERSAO"))}


def with_entries(documents: DataFrame, index: DataFrame, key: list[str] = ("content_sha256", "cnpj", "dt_refer", "versao")) -> DataFrame:
    """documents (cells of the index's key, and what tells a document) with the key typed and their entry of the index, nulls where it has none. Joined with their rows, which are many more and so need not meet the index."""
    return documents.withColumns(_typed_key()).drop("cells").join(index, list(key), "left")


def with_reason(typed: DataFrame, index: DataFrame | None, companies: list[int] | Column | None = None, key: list[str] = ("content_sha256", "cnpj", "dt_refer", "versao"), broadcast_index: bool = False) -> DataFrame:
    """typed (cod_cvm, cnpj, dt_refer, dt_fim_exerc, versao, vl_conta) joined with the index, plus skip_reason: the first that holds, or null.

    index: none if typed has its entries already (with_entries).
    companies: the wanted ones, as a list or as a condition; an empty list is no filter.
    Without broadcast_index the engine picks the join, by the index's size at run time.
    """
    first = F.when(F.col("cod_cvm").isNull(), "bad_key")
    if isinstance(companies, Column) or companies:
        wanted = companies if isinstance(companies, Column) else F.col("cod_cvm").isin(list(companies))
        first = first.when(~wanted, "filtered_out")
    first = first.when(F.col("dt_refer").isNull() | F.col("dt_fim_exerc").isNull(), "bad_date").when((F.col("cnpj") == "") | F.col("cnpj").isNull() | F.col("versao").isNull() | (F.col("versao") < 1), "bad_key")
    early = typed.withColumn("skip_reason", first)
    found = early if index is None else early.join(F.broadcast(index) if broadcast_index else index, list(key), "left")
    later = F.when(F.col("is_ambiguous"), "ambiguous_index").when(F.col("dt_receb").isNull(), "no_index").when(F.col("vl_conta").isNull(), "bad_value")
    return found.withColumn("skip_reason", F.coalesce("skip_reason", later)).drop("is_ambiguous")


#: HotSpot leaves methods of more bytes of code uncompiled; Spark then runs wide rows in many small ones.
COMPILED_BYTES = 8000


def typed_cells(details: DataFrame) -> DataFrame:
    """Detail rows (content_sha256, retrieval_id, member, line_no, statement, consolidated, cells: map or struct, and the columns of with_entries if they are there) with typed columns."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(details.sparkSession.conf.get(limit)) > COMPILED_BYTES:
        details.sparkSession.conf.set(limit, COMPILED_BYTES)
    text = {c: X.trimmed(cell(c.upper())) for c in ("denom_cia", "coluna_df", "cd_conta", "ds_conta", "moeda", "escala_moeda")}
    shared = [c for c in ENTRY if c in details.columns]
    key = [v.alias(k) for k, v in _typed_key().items() if k not in shared]
    return details.select(
        "content_sha256", "retrieval_id", F.col("member").alias("source_member"), F.col("line_no").alias("source_line_no"), "statement", "consolidated",
        *key, *shared, X.digits_int(cell("CD_CVM")).alias("cod_cvm"),
        X.blank_to_null(cell("GRUPO_DFP")).alias("grupo_dfp"), X.upper_plain(cell("ORDEM_EXERC")).alias("ordem_exerc"), X.iso_date(cell("DT_INI_EXERC")).alias("dt_ini_exerc"),
        X.iso_date(cell("DT_FIM_EXERC")).alias("dt_fim_exerc"), X.decimal_value(cell("VL_CONTA")).alias("vl_conta"), X.yes_no(cell("ST_CONTA_FIXA")).alias("st_conta_fixa"),
        *[v.alias(k) for k, v in text.items()],
    )


def to_silver(details: DataFrame, index: DataFrame | None, run_id: str, companies: list[int] | Column | None = None, statements: list[str] | None = None, extractor_version: str = EXTRACTOR_VERSION) -> DataFrame:
    """All detail rows in the 29 silver columns plus skip_reason; rows without a reason are the silver table. Details that hold their entries (with_entries) need no index.

    Ids contain the extractor's version: what another version has extracted stays beside it.
    """
    if statements:
        details = details.where(F.col("statement").isin(list(statements)))
    rows = with_reason(typed_cells(details), index, companies)
    return rows.withColumns({
        "silver_id": X.row_id(F.col("content_sha256"), F.col("source_member"), F.col("source_line_no"), F.lit(extractor_version)),
        "extractor": F.lit(EXTRACTOR), "extractor_version": F.lit(extractor_version), "extraction_run_id": F.lit(run_id),
    }).select(*SILVER_COLUMNS, "skip_reason")


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rejected rows with theirs)."""
    return rows.where("skip_reason is null").drop("skip_reason"), rows.where("skip_reason is not null")
