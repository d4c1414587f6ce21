"""Table schemas, keys and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

VALUE = "decimal(38,10)"

RAW_DOCUMENT = "content_sha256 string, size_bytes bigint, media_type string, storage_path string, first_seen_at timestamp, first_seen_run_id string"
RETRIEVAL = (
    "retrieval_id string, content_sha256 string, provider_id string, provider_version string, source_tier string, dataset_id string, "
    "resource_key string, url string, requested_at timestamp, retrieved_at timestamp, http_status int, etag string, last_modified string, "
    "content_length bigint, content_type string, final_url string, run_id string"
)
CELLS = "content_sha256 string, member string, line_no int, cells map<string,string>"
MEMBERS = "content_sha256 string, member string, content binary"
RUN_EVENT = "run_id string, command string, status string, started_at timestamp, finished_at timestamp, event_ts timestamp, code_version string, runtime_version string, git_sha string, notes string"
HTTP_META = "status int, etag string, last_modified string, content_length bigint, content_type string, final_url string"
SIDECAR = (
    f"document struct<content_sha256:string,size_bytes:bigint,media_type:string,storage_path:string,first_seen_at:timestamp,first_seen_run_id:string>, "
    f"provenance struct<provider_id:string,provider_version:string,source_tier:string,dataset_id:string,resource_key:string,url:string,retrieved_at:timestamp,"
    f"http:struct<{HTTP_META.replace(' ', ':').replace(',:', ',')}>,run_id:string>"
)
SILVER_COLUMNS = [
    "silver_id", "content_sha256", "retrieval_id", "source_member", "source_line_no", "cnpj", "cod_cvm", "denom_cia", "dt_refer", "versao", "doc_id", "dt_receb", "link_doc",
    "statement", "consolidated", "grupo_dfp", "ordem_exerc", "dt_ini_exerc", "dt_fim_exerc", "coluna_df", "cd_conta", "ds_conta", "vl_conta", "st_conta_fixa", "moeda",
    "escala_moeda", "extractor", "extractor_version", "extraction_run_id",
]
GOLD_COLUMNS = [
    "fact_id", "entity_id", "cod_cvm", "denom_cia", "statement", "consolidated", "coluna_df", "cd_conta", "ds_conta", "period_type", "period_start", "period_end", "knowledge_date",
    "value", "unit", "currency", "ordem_exerc", "source_doc_id", "source_doc_version", "silver_id", "content_sha256", "retrieval_id", "locator", "extractor",
    "extractor_version", "extraction_run_id",
]
#: What a read of facts returns.
VIEW_COLUMNS = [c for c in GOLD_COLUMNS if c not in ("extractor", "extractor_version", "extraction_run_id")]

#: Logical key of a fact and the order of its versions.
FACT_KEY = ["cod_cvm", "statement", "consolidated", "cd_conta", "coluna_df", "period_end"]
VERSION_ORDER = ["knowledge_date", "source_doc_version", "fact_id"]

# Fixed values of the data's publisher and of the tables.
STATEMENTS = ["DRE", "BPA", "BPP", "DFC_MI", "DFC_MD", "DVA", "DRA", "DMPL"]
MEMBER_PATTERN = "^dfp_cia_aberta_([A-Z]+(?:_[A-Z]{2})?)_(con|ind)_([0-9]{4})\\.csv$"
INDEX_PATTERN = "^dfp_cia_aberta_([0-9]{4})\\.csv$"
SCALE_FACTORS = {"MIL": 1000, "UNIDADE": 1}
CURRENCIES = {"REAL": "BRL"}
YEAR_DAYS = (330, 400)
SOURCE_TIERS = ["primary_official", "issuer", "public_web", "vendor_licensed", "derived"]  # strongest first
RUN_STATUSES = ["running", "success", "failed"]
#: Reasons for which a row is left out, in the order in which they are tried.
SILVER_REASONS = ["bad_key", "filtered_out", "bad_date", "ambiguous_index", "no_index", "bad_value"]
GOLD_REASONS = ["unknown_scale", "unknown_currency", "irregular_period", "contract_violation"]
EXTRACTOR, EXTRACTOR_VERSION = "dfp_csv", "1.1.0"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
