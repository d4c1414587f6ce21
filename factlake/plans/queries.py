"""The reference operators as queries over the given tables. Dates go out as text, values as doubles."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import asof, catalog, gold, incremental, lineage, quality, restate, silver
from ..schemas import EXTRACTOR, EXTRACTOR_VERSION, FACT_KEY
from ..sources.archives import classify_members, require_intact, with_intact
from ..sources.scratch import new_path, written
from ..sources.layout import lay_out, read_laid_out
from ..sources.sinks import append_new, ingest_batch, new_rows, register_documents
from ..sources.sinks import run_log as sink_run_log
from . import driver_tables as D

DAY = date(1998, 6, 30)
KEY = ["cod_cvm", "consolidated", "cd_conta", "period_end"]
FACT = ["fact_id", *KEY, "knowledge_date", "source_doc_version", "value"]


def _out(df: DataFrame, *columns: str | Column) -> DataFrame:
    df = df.select(*columns) if columns else df
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string" if kinds[c] == "date" else "double" if kinds[c].startswith("decimal") else kinds[c]).alias(c) for c in df.columns])


def as_of_all_keys(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.as_of(D.facts(s, d), DAY), *FACT)


def as_of_single_key(s: SparkSession, d: str) -> DataFrame:
    one = asof.fact_key_filter(D.facts(s, d), cod_cvm=7, cd_conta="R", consolidated=False)
    return _out(asof.as_of(one, DAY), *FACT)


def laid_out_reads(s: SparkSession, d: str) -> DataFrame:
    """as_of_single_key of facts laid out by key and day, of which the files with the key's box are opened."""
    facts, path = D.facts(s, d), new_path(s, "laid-out")
    lay_out(facts, path, ["cod_cvm", "cd_conta"], rows_per_file=2_000)
    one = read_laid_out(s, path, facts.schema, {"cod_cvm": 7, "cd_conta": "R"}, until=DAY)
    return _out(asof.as_of(asof.fact_key_filter(one, cod_cvm=7, cd_conta="R", consolidated=False), DAY), *FACT)


def latest_facts(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.latest(D.facts(s, d), date(2005, 1, 1)), *FACT)


def fact_history(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.history(D.all_facts(s, d, by_key=True)), *FACT, "version_no")


def version_deltas(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.version_deltas(D.all_facts(s, d, by_key=True)), *FACT, "previous_value", "step")


def validity_intervals(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.with_validity(D.facts(s, d)), *FACT, "valid_from", "valid_to")


def _restated(df: DataFrame) -> DataFrame:
    return _out(df, *KEY, F.col("original.fact_id").alias("original_id"), F.col("original.value").alias("original_value"), F.col("revised.fact_id").alias("revised_id"),
                F.col("revised.value").alias("revised_value"), "delta", "delta_pct")


def restatements_all(s: SparkSession, d: str) -> DataFrame:
    return _restated(restate.restatements(D.all_facts(s, d, by_key=True)))


def restatements_filtered(s: SparkSession, d: str) -> DataFrame:
    return _restated(restate.restatements(D.all_facts(s, d), cd_conta="R", consolidated=False))


def restatements_min_pct(s: SparkSession, d: str) -> DataFrame:
    return _restated(restate.restatements(D.all_facts(s, d, by_key=True), min_abs_pct=50))


def unstable_keys(s: SparkSession, d: str) -> DataFrame:
    return _out(restate.unstable_keys(D.all_facts(s, d)), *KEY, "versions", "low", "high")


def restatement_flag(s: SparkSession, d: str) -> DataFrame:
    return _out(restate.flag_restatements(D.all_facts(s, d, by_key=True)), *FACT, "is_restatement")


def as_of_join_probes(s: SparkSession, d: str) -> DataFrame:
    events = D.table(s, d, "events")
    known = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("knowledge_date"), F.lit(1).alias("source_doc_version"), F.col("event_id").alias("fact_id"), "value")
    probes = events.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("as_of"))
    return asof.asof_join(probes, known, ["user_id"]).select("event_id", "user_id", F.col("fact.fact_id").alias("known_event"), F.col("fact.value").alias("known_value"))


def as_of_join_hot_keys(s: SparkSession, d: str) -> DataFrame:
    """Three keys hold all rows, so ranges of (key, time) are merged."""
    probes = D.table(s, d, "orders").select("o_orderkey", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("cd_conta"), F.col("o_orderdate").cast("date").alias("as_of"))
    out = asof.asof_join(probes, D.all_facts(s, d), ["cd_conta"], rows_per_task=10_000)
    return _out(out.select("o_orderkey", "cd_conta", F.col("fact.fact_id").alias("fact_id"), F.col("fact.value").alias("value"), F.col("fact.knowledge_date").alias("knowledge_date")))


#: Every tenth day of the data's years.
PANEL_DAYS = [date(1992, 1, 1) + timedelta(days=10 * i) for i in range(256)]


def as_of_panel_many_days(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.as_of_panel(D.facts(s, d), PANEL_DAYS).groupBy("as_of", "cd_conta").agg(F.count(F.lit(1)).alias("known"), F.sum("source_doc_version").alias("versions"), F.sum(F.col("value").cast("decimal(28,2)")).cast("decimal(38,2)").alias("total")))


def _batches(facts: DataFrame) -> list[DataFrame]:
    """Facts as they might arrive: landed in three parts, early and late knowledge mixed, the second of which comes twice."""
    part = F.pmod(F.crc32(F.col("fact_id").cast("binary")), F.lit(3))
    landed = written(facts.withColumn("batch", part), "landed")
    return [landed.where(F.col("batch") == i).drop("batch") for i in (2, 0, 2, 1)]


#: What the tables kept by batches need of a fact.
_KEPT = [*FACT_KEY, "knowledge_date", "source_doc_version", "fact_id", "value"]


def validity_by_batches(s: SparkSession, d: str) -> DataFrame:
    facts, path = D.facts(s, d).select(*_KEPT), new_path(s, "validity")
    for batch in _batches(facts):
        incremental.merge_validity(batch, path, buckets=16, landed=True)
    return _out(incremental.read_validity(s, path, facts), *FACT, "valid_from", "valid_to")


def restatements_by_batches(s: SparkSession, d: str) -> DataFrame:
    facts, path = D.all_facts(s, d).select(*_KEPT), new_path(s, "ends")
    for batch in _batches(facts):
        incremental.merge_ends(batch, path, buckets=16, landed=True)
    return _restated(incremental.read_restatements(s, path, facts))


def appended_by_batches(s: SparkSession, d: str) -> DataFrame:
    facts, path = D.facts(s, d).withColumn("content_sha256", F.sha2((F.col("part") % 20).cast("string"), 256)).select(*_KEPT, "content_sha256"), new_path(s, "appended")
    for batch in _batches(facts):
        append_new(batch, path, "fact_id", ["knowledge_date"], "content_sha256", landed=True)
    return _out(s.read.parquet(path), *FACT)


def ingest_outcomes(s: SparkSession, d: str) -> DataFrame:
    """documents as two landed batches; both are sent again and answered from the ledger."""
    seen = D.retrievals(s, d).where("content_sha256 is not null")
    landed = seen.select("retrieval_id", "content_sha256", "resource_key", F.timestamp_seconds("retrieved_at").alias("retrieved_at"), F.lit("run").alias("run_id"), "size_bytes", F.lit("text").alias("media_type"), F.lit("").alias("storage_path"))
    first, second = (landed.where(F.col("retrieval_id").cast("long") % 3 == 0), landed.where(F.col("retrieval_id").cast("long") % 3 > 0))
    paths = new_path(s, "raw"), new_path(s, "retrieval")
    for batch, name in ((first, "a"), (second, "b")):
        ingest_batch(batch, *paths, name)
    return ingest_batch(first, *paths, "a").unionByName(ingest_batch(second, *paths, "b"))


def as_of_panel(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.as_of_panel(D.facts(s, d), [date(1997, 6, 30), DAY, date(2000, 6, 30)]), "as_of", *FACT)


def as_of_diff(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.as_of_diff(D.facts(s, d), date(1997, 6, 30), date(1999, 6, 30)), *KEY, "early_value", "late_value")


def _silver(s: SparkSession, d: str, companies: Column | None = None, statements: list[str] | None = None) -> DataFrame:
    return silver.to_silver(D.details(s, d, D.index(s, d)), None, "run1", companies, statements)


def _wanted() -> Column:
    return F.col("cod_cvm") % 7 != 3


def _classified(s: SparkSession, d: str) -> DataFrame:
    rows = _silver(s, d, _wanted())
    reason = gold.gold_reason(*[F.col(c) for c in ("escala_moeda", "moeda", "dt_ini_exerc", "dt_fim_exerc", "dt_receb", "cnpj", "vl_conta")])
    return rows.withColumn("skip_reason", F.coalesce("skip_reason", reason))


def gold_scale_currency_period(s: SparkSession, d: str) -> DataFrame:
    rows = _silver(s, d).where("skip_reason is null").select(
        X.scaled(F.col("vl_conta"), F.col("escala_moeda")).alias("value"), X.currency(F.col("moeda")).alias("currency"), X.period_type(F.col("dt_ini_exerc"), F.col("dt_fim_exerc")).alias("period_type"), "cd_conta"
    )
    return _out(rows.groupBy("cd_conta", "currency", "period_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(38,2)")).cast("decimal(38,2)").alias("total")))


def gold_contract_quarantine(s: SparkSession, d: str) -> DataFrame:
    rows = D.all_facts(s, d).withColumns({"period_type": F.lit("instant"), "period_start": F.when(F.col("source_doc_version") == 1, F.col("period_end"))})
    flags = ["known_too_early", "instant_with_start", "flow_without_start", "reversed_period"]
    return gold.contract_violations(rows).groupBy("cd_conta", *flags).agg(F.count(F.lit(1)).alias("rows"))


def gold_quality_report(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(_classified(s, d))


def loss_totals(s: SparkSession, d: str) -> DataFrame:
    return quality.loss_totals(_classified(s, d), ["cd_conta"])


def report_rollup(s: SparkSession, d: str) -> DataFrame:
    return quality.report_rollup(_classified(s, d), "cd_conta")


def index_ambiguous_keys(s: SparkSession, d: str) -> DataFrame:
    return _out(D.index(s, d), "cnpj", "dt_refer", "is_ambiguous", "doc_id", "dt_receb")


def detail_index_join(s: SparkSession, d: str) -> DataFrame:
    return _out(_silver(s, d).where("skip_reason is null"), "source_member", "source_line_no", "cod_cvm", "doc_id", "dt_receb", "vl_conta")


def skip_reason_report(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(_silver(s, d), ["statement"])


def company_filter(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(_silver(s, d, F.col("cod_cvm").isin(1, 2, 3, 5, 8)))


def statement_filter(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(_silver(s, d, None, ["BPA"]), ["statement"])


def year_filter(s: SparkSession, d: str) -> DataFrame:
    rows = D.lines(s, d).withColumn("year", F.year("o_orderdate"))
    return catalog.year_filter(rows, "year", "1995-1996, 1998", 1990).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


def content_registry(s: SparkSession, d: str) -> DataFrame:
    seen = D.retrievals(s, d).select("content_sha256", "size_bytes", F.lit("text").alias("media_type"), F.lit("").alias("storage_path"), F.col("retrieved_at").alias("seen_at"), F.col("retrieval_id").alias("run_id"))
    known = D.raw_documents(s, d).where("first_seen_at % 3 = 0")
    return register_documents(seen, known).select("content_sha256", "size_bytes", "first_seen_at", "first_seen_run_id", "is_new")


def first_retrieval(s: SparkSession, d: str) -> DataFrame:
    return catalog.first_observations(D.retrievals(s, d))


def documents_for(s: SparkSession, d: str) -> DataFrame:
    return catalog.documents_for(D.retrievals(s, d), D.raw_documents(s, d).select("content_sha256", "size_bytes"), "src0", ["en", "fr"]).drop("dataset_id")


def resource_versions(s: SparkSession, d: str) -> DataFrame:
    return catalog.resource_versions(D.retrievals(s, d), D.raw_documents(s, d))


def changed_resources(s: SparkSession, d: str) -> DataFrame:
    return catalog.changed_resources(D.retrievals(s, d))


def top_changed(s: SparkSession, d: str) -> DataFrame:
    return catalog.top_changed(D.retrievals(s, d), 10)


def catalog_totals(s: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_totals(D.raw_documents(s, d), D.retrievals(s, d), D.table(s, d, "events"))


def tier_share(s: SparkSession, d: str) -> DataFrame:
    return catalog.tier_share(catalog.tier_at_least(D.retrievals(s, d), "public_web"))


def _linked(s: SparkSession, d: str) -> DataFrame:
    """Facts with the document they come from."""
    n = D.table(s, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    rows = D.facts(s, d).join(F.broadcast(n)).withColumn("retrieval_id", (F.col("part") % F.col("n_docs")).cast("string"))
    return rows.join(D.retrievals(s, d).select("retrieval_id", "content_sha256"), "retrieval_id")


def provenance_chain(s: SparkSession, d: str) -> DataFrame:
    part = F.col("part").cast("string")
    rows = _linked(s, d).withColumns({
        "locator": X.locator(F.concat(F.lit("p"), part, F.lit(".csv")), F.col("source_doc_version") + 1, F.col("cd_conta"), F.lit("")), "source_doc_id": part,
        "extractor": F.lit(EXTRACTOR), "extractor_version": F.lit(EXTRACTOR_VERSION), "extraction_run_id": F.concat(F.lit("run"), F.col("source_doc_version").cast("string")),
    })
    seen = D.retrievals(s, d).withColumns({"provider_id": F.concat(F.lit("p"), F.col("dataset_id")), "url": F.concat(F.lit("https://"), F.col("dataset_id"), F.lit("/"), F.col("retrieval_id"))})
    return _out(lineage.provenance(rows, seen, D.raw_documents(s, d).withColumn("storage_path", F.concat(F.substring("content_sha256", 1, 2), F.lit("/"), F.col("content_sha256")))))


def lineage_gaps(s: SparkSession, d: str) -> DataFrame:
    labelled = D.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("retrieval_id"))
    return lineage.lineage_gaps(_linked(s, d), labelled, D.raw_documents(s, d).where("size_bytes < 3000"))


def _located(s: SparkSession, d: str) -> DataFrame:
    return D.lines(s, d).select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"),
        X.locator(F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit(".csv")), F.col("l_linenumber") + 1, F.col("l_returnflag"), F.when(F.col("l_linenumber") == 4, F.lit("col")).otherwise(F.lit(""))).alias("locator"),
    )


def locator_build(s: SparkSession, d: str) -> DataFrame:
    return _located(s, d)


def locator_parse(s: SparkSession, d: str) -> DataFrame:
    return lineage.with_locator_parts(_located(s, d)).select("orderkey", "partkey", "member", "line_no", "account", "column")


def duplicate_ids(s: SparkSession, d: str) -> DataFrame:
    return lineage.duplicate_ids(D.table(s, d, "lineitem").select(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")), "id")


def size_conflicts(s: SparkSession, d: str) -> DataFrame:
    odd = D.retrievals(s, d).withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("retrieved_at") % 5 == 0, 1).otherwise(0))
    return lineage.size_conflicts(odd)


def constraint_audit(s: SparkSession, d: str) -> DataFrame:
    rules = quality.DOCUMENT_RULES | {"short": "size_bytes < 10000", "tier": "source_tier <> 'derived'"}
    return quality.audit_constraints(D.retrievals(s, d), rules, "retrieval_id")


def idempotent_append(s: SparkSession, d: str) -> DataFrame:
    rows = D.facts(s, d)
    batch = rows.where("source_doc_version >= 3").unionByName(rows.where("source_doc_version = 7"))
    return _out(new_rows(batch, rows.where("source_doc_version <= 4"), "fact_id"), *FACT)


def all_versions_union(s: SparkSession, d: str) -> DataFrame:
    """Facts of two extractor versions, the newer of which has read all rows and the older even lines only: both stay, and a second run of the newer adds nothing."""
    facts = lambda rows, version: silver.split_quarantine(gold.to_facts(silver.split_quarantine(silver.to_silver(rows, None, "run1", extractor_version=version))[0]))[0]
    rows = D.details(s, d, D.index(s, d))
    columns = ["fact_id", "extractor_version", "cd_conta"]
    # read twice: typed and joined once
    old, new = written(facts(rows.where("line_no % 2 = 0"), "1.0.0").select(*columns), "old-facts"), facts(rows, EXTRACTOR_VERSION).select(*columns)
    table = new_rows(old, old.limit(0), "fact_id", ["cd_conta"]).unionByName(new_rows(new, old, "fact_id", ["cd_conta"]))
    return table.groupBy("extractor_version", "cd_conta").agg(F.count(F.lit(1)).alias("facts"), F.min("fact_id").alias("first_id"), F.max("fact_id").alias("last_id"))


def run_log(s: SparkSession, d: str) -> DataFrame:
    """Users as runs: errors are failures, purchases successes, all else says that the run goes on."""
    events = D.table(s, d, "events").select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"), F.col("ts").alias("event_ts"), F.col("event_type").alias("command")
    )
    ended = F.col("status") != "running"
    log = sink_run_log(events.withColumns({"started_at": F.when(~ended, F.col("event_ts")), "finished_at": F.when(ended, F.col("event_ts"))}))
    return log.select("run_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_us"), "status")


def recent_runs(s: SparkSession, d: str) -> DataFrame:
    runs = D.table(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("command"), F.col("ts").alias("started_at"))
    return catalog.recent_runs(runs, 20).select("run_id", "command")


def silver_typed_projection(s: SparkSession, d: str) -> DataFrame:
    rows = silver.split_quarantine(_silver(s, d))[0]
    return _out(rows.withColumn("st_conta_fixa", F.col("st_conta_fixa").cast("string")))


def _gold(s: SparkSession, d: str) -> DataFrame:
    return silver.split_quarantine(gold.to_facts(silver.split_quarantine(_silver(s, d))[0]))[0]


def gold_fact_projection(s: SparkSession, d: str) -> DataFrame:
    return _out(_gold(s, d).withColumn("value_thousands", X.thousands(F.col("value"))))


def fact_view(s: SparkSession, d: str) -> DataFrame:
    return _out(asof.fact_view(_gold(s, d)))


def quarantine_split(s: SparkSession, d: str) -> DataFrame:
    good, bad = silver.split_quarantine(_silver(s, d))
    sides = good.select("statement", F.lit(True).alias("kept")).unionByName(bad.select("statement", F.lit(False).alias("kept")))
    return sides.groupBy("statement", "kept").agg(F.count(F.lit(1)).alias("rows"))


def table_counts(s: SparkSession, d: str) -> DataFrame:
    # a silver row gives a fact or a reason for none: typed and joined once for both counts
    rows = gold.to_facts(silver.split_quarantine(_silver(s, d))[0])
    return quality.counts_where(rows, {"silver": F.lit(True), "gold": F.col("skip_reason").isNull()})


def silver_audit(s: SparkSession, d: str) -> DataFrame:
    rules = quality.SILVER_RULES | {"value": "abs(vl_conta) < 50000"}
    return quality.audit_constraints(silver.split_quarantine(_silver(s, d))[0], rules, "silver_id").groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def member_kinds(s: SparkSession, d: str) -> DataFrame:
    members = D.archive_members(s, d)
    return classify_members(members).groupBy("statement", "consolidated", "member_year").agg(F.count(F.lit(1)).alias("rows"))


def content_hashes(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "documents").select("doc_id", X.content_hash(F.col("text").cast("binary")).alias("content_sha256"))


def verified_reads(s: SparkSession, d: str) -> DataFrame:
    """Stored contents, some of which have changed since they were registered: the intact ones are read, and again held against their hash."""
    held = with_intact(D.stored_contents(s, d))
    read = require_intact(held.where("intact")).select("content_sha256", "intact", F.octet_length("content").cast("long").alias("size_bytes"))
    return read.unionByName(held.where("not intact").select("content_sha256", "intact", F.lit(None).cast("long").alias("size_bytes")))


def corrupt_facts(s: SparkSession, d: str) -> DataFrame:
    return lineage.corrupt_facts(_linked(s, d), lineage.rehashed(D.raw_documents(s, d), D.stored_contents(s, d)))


def _amounts(s: SparkSession, d: str) -> DataFrame:
    """Values that grow to 10^28, and close ones: part and price as digits of a number. Those of longer parts are in units of 10^shift: the percentage is the same."""
    # a value holds six digits of the part beside the 22 others
    shift = F.when(F.col("l_linenumber") % 2 == 0, F.greatest(F.length(F.col("l_partkey").cast("string")) - 6, F.lit(0))).otherwise(0)
    digits = F.concat(F.col("l_partkey").cast("string"), F.expr("rpad('1', 22 - shift, '0')"))
    return D.lines(s, d).withColumn("shift", shift).select(
        "l_orderkey", "l_linenumber", "l_partkey", "shift", F.when(F.col("l_linenumber") % 2 == 0, digits).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).cast("decimal(38,10)").alias("o"),
        F.concat((F.col("l_linenumber") - 3).cast("string"), F.lit("E-"), F.col("shift").cast("string")).cast("decimal(38,10)").alias("d"),
    )


def large_deltas(s: SparkSession, d: str) -> DataFrame:
    rows = _amounts(s, d).withColumn("r", F.try_add("o", F.col("d") * F.lit(1).cast("decimal(1,0)")).cast("decimal(38,10)"))
    unit = F.concat(F.lit("1E"), F.col("shift").cast("string")).cast("decimal(11,0)")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", (X.delta(F.col("o"), F.col("r")).cast("decimal(26,10)") * unit).cast("decimal(38,10)").cast("string").alias("delta"), (X.delta_pct(F.col("o"), F.col("r")) * 1_000_000).cast("long").alias("delta_pct_millionths"),
        X.at_least_pct(F.col("o"), F.col("r"), 0.000101).alias("passes"), X.at_least_pct(F.col("o"), F.col("r"), "0.000000000000000003").alias("passes_fine"),
    )


QUERIES = {f.__name__: f for f in (
    as_of_all_keys, as_of_single_key, latest_facts, fact_history, version_deltas, validity_intervals, restatements_all, restatements_filtered, restatements_min_pct, unstable_keys, restatement_flag,
    as_of_join_probes, as_of_join_hot_keys, as_of_panel, as_of_panel_many_days, as_of_diff, validity_by_batches, restatements_by_batches, appended_by_batches, ingest_outcomes, gold_scale_currency_period, gold_contract_quarantine, gold_quality_report, loss_totals, report_rollup, index_ambiguous_keys, detail_index_join,
    skip_reason_report, company_filter, statement_filter, year_filter, content_registry, first_retrieval, documents_for, resource_versions, changed_resources, top_changed, catalog_totals, tier_share,
    provenance_chain, lineage_gaps, corrupt_facts, verified_reads, content_hashes, member_kinds, quarantine_split, table_counts, silver_audit, fact_view, large_deltas, locator_build, locator_parse, duplicate_ids, size_conflicts, constraint_audit, idempotent_append, all_versions_union, recent_runs, run_log, laid_out_reads, silver_typed_projection, gold_fact_projection,
)}
