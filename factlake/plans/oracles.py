"""SQL that gives the rows of the queries."""

from __future__ import annotations

_ALL = """
f as (
  select sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date))) fact_id, l_suppkey cod_cvm, l_linestatus = 'O' consolidated, l_returnflag cd_conta,
         make_date(year(o_orderdate) - 1, 12, 31) period_end, cast(l_shipdate as date) knowledge_date, l_linenumber source_doc_version, cast(l_extendedprice as decimal(18,2)) v, l_partkey part
  from lineitem join orders on l_orderkey = o_orderkey)
"""
_OK = _ALL + ", g as (select * from f where knowledge_date >= period_end)"
_KEY = "cod_cvm, consolidated, cd_conta, period_end"
_KEY_OUT = "cod_cvm, consolidated, cd_conta, cast(period_end as varchar) period_end"
_FACT = f"fact_id, {_KEY_OUT}, cast(knowledge_date as varchar) knowledge_date, source_doc_version, cast(v as double) as value"
_LATEST = "knowledge_date desc, source_doc_version desc, fact_id"
_ORDER = "knowledge_date, source_doc_version, fact_id"


def _as_of(day: str, where: str = "true", table: str = "g") -> str:
    return f"(select * from {table} where knowledge_date <= date '{day}' and {where} qualify row_number() over (partition by {_KEY} order by {_LATEST}) = 1)"


def _restated(where: str = "true", after: str = "true") -> str:
    first, last = (f"first_value({{0}}) over (partition by {_KEY} order by {_ORDER})", f"last_value({{0}}) over (partition by {_KEY} order by {_ORDER} rows between unbounded preceding and unbounded following)")
    return f"""with {_ALL},
r as (select distinct {_KEY}, {first.format('fact_id')} original_id, {first.format('v')} o, {last.format('fact_id')} revised_id, {last.format('v')} n from f where {where})
select {_KEY_OUT}, original_id, cast(o as double) original_value, revised_id, cast(n as double) revised_value, cast(n - o as double) delta,
       sign(n - o) * ((cast(abs(n - o) * 100 as hugeint) * 200000000 + cast(abs(o) * 100 as hugeint)) // (2 * cast(abs(o) * 100 as hugeint))) / 1e6 delta_pct
from r where o <> n and {after}"""


_RAW = """
x as (select *, lpad(cast(o_custkey as varchar), 14, '0') p from lineitem join orders on l_orderkey = o_orderkey),
raw as (
  select p cnpj, case when l_linenumber = 7 and l_quantity > 45 then null else l_suppkey end cod_cvm, cast(date_trunc('quarter', o_orderdate) as date) dt_refer,
         case when l_linenumber = 5 and l_quantity > 40 then null else cast(l_shipdate as date) end dt_fim_exerc,
         case when l_linenumber % 2 = 0 then null when l_linenumber = 3 then cast(o_orderdate as date) else cast(l_shipdate as date) - 364 end dt_ini_exerc,
         case when l_linenumber = 6 and l_quantity > 30 then null else cast(l_extendedprice as decimal(18,2)) end vl_conta,
         case l_returnflag when 'N' then 'MIL' when 'R' then 'Unidade' else 'MILHAO' end escala_moeda, case when l_suppkey % 10 = 0 then 'DOLAR' else 'REAL' end moeda,
         l_returnflag cd_conta, l_linestatus, l_linenumber, 'm' || l_orderkey source_member, l_linenumber + 1 source_line_no, case when l_linestatus = 'O' then 'DRE' else 'BPA' end as statement
  from x),
ix as (
  select lpad(cast(o_custkey as varchar), 14, '0') cnpj, cast(date_trunc('quarter', o_orderdate) as date) dt_refer, count(*) > 1 is_ambiguous,
         case when count(*) = 1 then min(cast(o_orderkey as varchar)) end doc_id, case when count(*) = 1 then min(cast(o_orderdate as date)) end dt_receb
  from orders where o_orderstatus <> 'P' group by 1, 2),
j as (select raw.*, ix.doc_id, ix.dt_receb, ix.is_ambiguous from raw left join ix on raw.cnpj = ix.cnpj and raw.dt_refer = ix.dt_refer)
"""


def _reason(wanted: str, with_gold: bool) -> str:
    gold = """when escala_moeda = 'MILHAO' then 'unknown_scale' when moeda = 'DOLAR' then 'unknown_currency'
            when dt_ini_exerc is not null and datediff('day', dt_ini_exerc, dt_fim_exerc) + 1 not between 330 and 400 then 'irregular_period' when dt_receb < dt_fim_exerc then 'contract_violation'"""
    return f"""s as (select *, case when cod_cvm is null then 'bad_key' when not ({wanted}) then 'filtered_out' when dt_fim_exerc is null then 'bad_date' when is_ambiguous then 'ambiguous_index'
            when dt_receb is null then 'no_index' when vl_conta is null then 'bad_value' {gold if with_gold else ''} end reason from j)"""


_SILVER_ID = "substr(sha256('orders|' || source_member || '|' || source_line_no || '|1.1.0'), 1, 32)"
_EXERC = "case when l_linenumber % 2 = 0 then 'ULTIMO' else 'PENULTIMO' end"
_COLUNA = "case when l_linenumber = 4 then 'col' else '' end"
_GOLD = f"""{_RAW}, {_reason('true', True)},
g as (
  select {_SILVER_ID} fact_id, 'br:cnpj:' || cnpj entity_id, cast(cod_cvm as int) cod_cvm, 'ACME' denom_cia, statement, l_linestatus = 'O' consolidated, {_COLUNA} coluna_df, cd_conta, l_linestatus ds_conta,
         case when dt_ini_exerc is null then 'instant' else 'year' end period_type, cast(dt_ini_exerc as varchar) period_start, cast(dt_fim_exerc as varchar) period_end, cast(dt_receb as varchar) knowledge_date,
         cast(vl_conta * case escala_moeda when 'MIL' then 1000 else 1 end as double) as value, 'BRL' unit, 'BRL' currency, {_EXERC} ordem_exerc, doc_id source_doc_id, 1 source_doc_version, {_SILVER_ID} silver_id,
         'orders' content_sha256, 'r1' retrieval_id, source_member || '#L' || source_line_no || ':cd_conta=' || cd_conta || case when {_COLUNA} <> '' then ':coluna=' || {_COLUNA} else '' end locator,
         'dfp_csv' extractor, '1.1.0' extractor_version, 'run1' extraction_run_id
  from s where reason is null)"""

_SEEN = """
e as (
  select case when doc_id % 2 = 0 then 'm' || lpad(cast(doc_id as varchar), 8, '0') end last_modified, cast(doc_id as varchar) retrieval_id, sha256(text) content_sha256, source dataset_id, lang resource_key, n_chars size_bytes, doc_id retrieved_at,
         case lang when 'en' then 'primary_official' when 'de' then 'issuer' when 'fr' then 'public_web' else 'derived' end source_tier from documents),
c as (select content_sha256, min(retrieved_at) first_seen_at, max(size_bytes) size_bytes from e group by 1)
"""
_LINKED = f"{_OK}, {_SEEN}, k as (select g.*, e.* from g join e on e.retrieval_id = cast(g.part % (select count(*) from documents) as varchar))"
_FIRST = "select dataset_id, resource_key, content_sha256, arg_min(retrieval_id, retrieved_at) retrieval_id, min(retrieved_at) first_seen_at from e group by 1, 2, 3"
_CHANGED = "select dataset_id, resource_key, count(distinct content_sha256) versions from e group by 1, 2 having count(distinct content_sha256) > 1"
_LOCATOR = """select l_orderkey orderkey, l_linenumber linenumber, l_partkey partkey, 'm' || l_orderkey || '.csv#L' || (l_linenumber + 1) || ':cd_conta=' || l_returnflag || case when l_linenumber = 4 then ':coluna=col' else '' end locator
from lineitem join orders on l_orderkey = o_orderkey"""
_REPORT = "coalesce(reason, 'ok') reason, count(*) as rows"

ORACLES = {
    "as_of_all_keys": f"with {_OK} select {_FACT} from {_as_of('1998-06-30')}",
    "as_of_single_key": f"with {_OK} select {_FACT} from {_as_of('1998-06-30', "cod_cvm = 7 and cd_conta = 'R' and not consolidated")}",
    "latest_facts": f"with {_OK} select {_FACT} from {_as_of('2005-01-01')}",
    "fact_history": f"with {_ALL} select {_FACT}, cast(row_number() over (partition by {_KEY} order by {_ORDER}) as int) version_no from f",
    "version_deltas": f"with {_ALL}, p as (select *, lag(v) over (partition by {_KEY} order by {_ORDER}) b from f) select {_FACT}, cast(b as double) previous_value, cast(v - b as double) step from p",
    "validity_intervals": f"""with {_OK}, o as (select * from g qualify row_number() over (partition by {_KEY}, knowledge_date order by source_doc_version desc, fact_id) = 1)
        select {_FACT}, cast(knowledge_date as varchar) valid_from, cast(lead(knowledge_date) over (partition by {_KEY} order by knowledge_date) as varchar) valid_to from o""",
    "restatements_all": _restated(),
    "restatements_filtered": _restated("cd_conta = 'R' and not consolidated"),
    "restatements_min_pct": _restated(after="abs(n - o) * 100 >= 50 * abs(o)"),
    "unstable_keys": f"with {_ALL} select {_KEY_OUT}, count(*) versions, cast(min(v) as double) low, cast(max(v) as double) high from f group by {_KEY} having count(distinct v) > 1",
    "restatement_flag": f"""with {_ALL}, q as (select *, datediff('day', date '1970-01-01', knowledge_date) n from f),
        r as (select *, min(v) over w a, max(v) over w b from q window w as (partition by {_KEY} order by n range between unbounded preceding and 1 preceding))
        select {_FACT}, coalesce(a <> v or b <> v, false) is_restatement from r""",
    "as_of_join_probes": """select p.event_id, p.user_id, f.event_id known_event, f.value known_value
        from (select * from events where event_type = 'error') p asof left join (select * from events where event_type = 'purchase') f on p.user_id = f.user_id and p.ts >= f.ts""",
    "as_of_panel": f"with {_OK} " + " union all ".join(f"select '{d}' as_of, {_FACT} from {_as_of(d)}" for d in ("1997-06-30", "1998-06-30", "2000-06-30")),
    "as_of_diff": f"""with {_OK}, a as (select {_KEY}, v from {_as_of('1997-06-30')}), b as (select {_KEY}, v from {_as_of('1999-06-30')})
        select {_KEY_OUT}, cast(early as double) early_value, cast(late as double) late_value
        from (select {', '.join(f'coalesce(a.{k}, b.{k}) {k}' for k in _KEY.split(', '))}, a.v early, b.v late from a full join b on {' and '.join(f'a.{k} = b.{k}' for k in _KEY.split(', '))})
        where early is distinct from late""",
    "gold_scale_currency_period": f"""with {_RAW}, {_reason('true', False)},
        t as (select cd_conta, case moeda when 'REAL' then 'BRL' end currency,
              case when dt_ini_exerc is null then 'instant' when datediff('day', dt_ini_exerc, dt_fim_exerc) + 1 between 330 and 400 then 'year' end period_type,
              vl_conta * case escala_moeda when 'MIL' then 1000 when 'Unidade' then 1 end as value from s where reason is null)
        select cd_conta, currency, period_type, count(*) as rows, cast(cast(sum(value) as decimal(38,2)) as double) total from t group by 1, 2, 3""",
    "gold_contract_quarantine": f"""with {_ALL}, t as (select cd_conta, knowledge_date < period_end known_too_early, source_doc_version = 1 instant_with_start from f)
        select cd_conta, known_too_early, instant_with_start, false flow_without_start, false reversed_period, count(*) as rows from t group by 1, 2, 3""",
    "gold_quality_report": f"with {_RAW}, {_reason('cod_cvm % 7 <> 3', True)} select {_REPORT} from s group by 1",
    "loss_totals": f"""with {_RAW}, {_reason('cod_cvm % 7 <> 3', True)}
        select cd_conta, count(*) as read, count(*) filter (reason is null) emitted, count(*) filter (reason <> 'filtered_out') lost, count(*) filter (reason = 'filtered_out') filtered from s group by 1""",
    "report_rollup": f"""with {_RAW}, {_reason('cod_cvm % 7 <> 3', True)}
        select cd_conta, count(*) as read, count(*) filter (reason is null) emitted, count(*) filter (reason <> 'filtered_out') lost from s group by rollup (cd_conta)""",
    "index_ambiguous_keys": f"with {_RAW} select cnpj, cast(dt_refer as varchar) dt_refer, is_ambiguous, doc_id, cast(dt_receb as varchar) dt_receb from ix",
    "detail_index_join": f"""with {_RAW}, {_reason('true', False)}
        select source_member, source_line_no, cast(cod_cvm as int) cod_cvm, doc_id, cast(dt_receb as varchar) dt_receb, cast(vl_conta as double) vl_conta from s where reason is null""",
    "skip_reason_report": f"with {_RAW}, {_reason('true', False)} select statement, {_REPORT} from s group by 1, 2",
    "company_filter": f"with {_RAW}, {_reason('cod_cvm in (1, 2, 3, 5, 8)', False)} select {_REPORT} from s group by 1",
    "statement_filter": f"with {_RAW}, {_reason('true', False)} select statement, {_REPORT} from s where statement = 'BPA' group by 1, 2",
    "year_filter": "select cast(year(o_orderdate) as int) as year, count(*) as rows from lineitem join orders on l_orderkey = o_orderkey where year(o_orderdate) in (1995, 1996, 1998) group by 1",
    "content_registry": f"""with {_SEEN} select content_sha256, arg_min(size_bytes, retrieved_at) size_bytes, min(retrieved_at) first_seen_at, arg_min(retrieval_id, retrieved_at) first_seen_run_id,
        min(retrieved_at) % 3 <> 0 is_new from e group by 1""",
    "first_retrieval": f"with {_SEEN} {_FIRST}",
    "documents_for": f"with {_SEEN}, o as ({_FIRST}) select resource_key, content_sha256, retrieval_id, o.first_seen_at, size_bytes from o join c using (content_sha256) where dataset_id = 'src0' and resource_key in ('en', 'fr')",
    "resource_versions": f"""with {_SEEN} select content_sha256, dataset_id, resource_key, min(retrieved_at) first_seen, max(retrieved_at) last_seen, count(*) times_seen, any_value(c.size_bytes) size_bytes, max(last_modified) last_modified
        from e join c using (content_sha256) group by 1, 2, 3""",
    "changed_resources": f"with {_SEEN} {_CHANGED}",
    "top_changed": f"with {_SEEN} {_CHANGED} order by versions desc, dataset_id, resource_key limit 10",
    "catalog_totals": f"with {_SEEN} select (select count(*) from c) documents, cast((select sum(size_bytes) from c) as bigint) bytes, (select count(*) from e) retrievals, (select count(*) from events) runs",
    "tier_share": f"with {_SEEN} select source_tier, count(*) as rows from e where source_tier <> 'derived' group by 1",
    "provenance_chain": f"""with {_LINKED} select fact_id, 'p' || part || '.csv#L' || (source_doc_version + 1) || ':cd_conta=' || cd_conta locator, 'dfp_csv' extractor, '1.1.0' extractor_version, 'run' || source_doc_version extraction_run_id,
        retrieval_id, 'p' || dataset_id provider_id, source_tier, dataset_id, resource_key, 'https://' || dataset_id || '/' || retrieval_id url, retrieved_at, k.content_sha256, c.size_bytes,
        substr(k.content_sha256, 1, 2) || '/' || k.content_sha256 storage_path, cast(part as varchar) source_doc_id, source_doc_version, cast(knowledge_date as varchar) knowledge_date
        from k join c on c.content_sha256 = k.content_sha256""",
    "lineage_gaps": f"""with {_LINKED} select fact_id, 'retrieval' gap from k where retrieval_id not in (select cast(doc_id as varchar) from labels)
        union all select fact_id, 'document' from k where content_sha256 not in (select content_sha256 from c where size_bytes < 3000)""",
    "locator_build": _LOCATOR,
    "locator_parse": """select l_orderkey orderkey, l_partkey partkey, 'm' || l_orderkey || '.csv' member, cast(l_linenumber + 1 as int) line_no, l_returnflag account, case when l_linenumber = 4 then 'col' else '' end as "column"
        from lineitem join orders on l_orderkey = o_orderkey""",
    "duplicate_ids": "select l_orderkey || '|' || l_linenumber id, count(*) n from lineitem group by 1 having count(*) > 1",
    "size_conflicts": f"with {_SEEN}, o as (select content_sha256, size_bytes + case when retrieved_at % 5 = 0 then 1 else 0 end s from e) select content_sha256, min(s) low, max(s) high from o group by 1 having min(s) <> max(s)",
    "constraint_audit": f"with {_SEEN} select retrieval_id, 'short' as rule from e where size_bytes >= 10000 union all select retrieval_id, 'tier' from e where source_tier = 'derived'",
    "idempotent_append": f"with {_OK} select {_FACT} from g where source_doc_version >= 3 and fact_id not in (select fact_id from g where source_doc_version <= 4)",
    "all_versions_union": f"""with {_GOLD}, u as (select extractor_version, cd_conta, fact_id from g union all
        select '1.0.0', cd_conta, {_SILVER_ID.replace('1.1.0', '1.0.0')} from s where reason is null and source_line_no % 2 = 0)
        select extractor_version, cd_conta, count(*) facts, min(fact_id) first_id, max(fact_id) last_id from (select extractor_version, fact_id, min(cd_conta) cd_conta from u group by 1, 2) group by 1, 2""",
    "run_log": """with e as (select user_id run_id, ts, case event_type when 'purchase' then 'success' when 'error' then 'failed' else 'running' end status from events),
        l as (select run_id, max((ts, status <> 'running', status)) x, min(ts) filter (status = 'running') started from e group by 1)
        select run_id, epoch_us(started) started_us, case when x[3] <> 'running' then epoch_us(x[1]) end finished_us, x[3] status from l""",
    "recent_runs": "select event_id run_id, event_type command from events order by ts desc, event_id limit 20",
    "silver_typed_projection": f"""with {_RAW}, {_reason('true', False)}
        select {_SILVER_ID} silver_id, 'orders' content_sha256, 'r1' retrieval_id, source_member, source_line_no, cnpj, cast(cod_cvm as int) cod_cvm, 'ACME' denom_cia,
               cast(dt_refer as varchar) dt_refer, 1 versao, doc_id, cast(dt_receb as varchar) dt_receb, cast(null as varchar) link_doc, statement, l_linestatus = 'O' consolidated, cast(null as varchar) grupo_dfp,
               {_EXERC} ordem_exerc, cast(dt_ini_exerc as varchar) dt_ini_exerc, cast(dt_fim_exerc as varchar) dt_fim_exerc,
               {_COLUNA} coluna_df, cd_conta, l_linestatus ds_conta, cast(vl_conta as double) vl_conta, case l_linenumber when 1 then 'true' when 2 then 'false' end st_conta_fixa,
               moeda, escala_moeda, 'dfp_csv' extractor, '1.1.0' extractor_version, 'run1' extraction_run_id
        from s where reason is null""",
    "gold_fact_projection": f"with {_GOLD} select *, 'cvm:' || lower(statement) || ':' || cd_conta || case when coluna_df <> '' then ':' || coluna_df else '' end metric, cast(round(value * 100) as bigint) / 100000::double value_thousands from g",
    "fact_view": f"with {_GOLD} select * exclude (extractor, extractor_version, extraction_run_id) from g",
    "quarantine_split": f"with {_RAW}, {_reason('true', False)} select statement, reason is null kept, count(*) as rows from s group by 1, 2",
    "table_counts": f"with {_RAW}, {_reason('true', True)} select 'gold' as name, count(*) filter (reason is null) as rows from s union all select 'silver', count(*) filter (reason is null or reason in ('unknown_scale', 'unknown_currency', 'irregular_period', 'contract_violation')) from s",
    "silver_audit": f"with {_RAW}, {_reason('true', False)}, a as (select unnest(case when vl_conta < 50000 then ['sha256'] else ['sha256', 'value'] end) as rule from s where reason is null) select rule, count(*) as rows from a group by 1",
    "member_kinds": """with m as (select o_orderkey % 6 k, cast(year(o_orderdate) as int) y from orders)
        select case k when 0 then 'DRE' when 1 then 'BPA' else 'DFC_MI' end as statement, k <> 1 consolidated, y member_year, count(*) as rows from m where k < 3 group by all""",
    "content_hashes": "select doc_id, sha256(text) content_sha256 from documents",
    "verified_reads": f"""with {_SEEN} select c.content_sha256, first_seen_at % 9 <> 0 intact, any_value(case when first_seen_at % 9 <> 0 then cast(octet_length(encode("text")) as bigint) end) size_bytes
        from c join documents on sha256("text") = c.content_sha256 group by 1, 2""",
    "corrupt_facts": f"with {_LINKED}, bad as (select content_sha256 from c where first_seen_at % 9 = 0) select fact_id from k where content_sha256 in (select content_sha256 from bad)",
    "large_deltas": """select l_orderkey, l_linenumber, l_partkey, cast(cast(l_linenumber - 3 as decimal(38,10)) as varchar) delta,
               cast(case when l_linenumber % 2 = 0 then 0 else sign(l_linenumber - 3) * ((abs(l_linenumber - 3) * 20000000000::hugeint + cents) // (2 * cents)) end as bigint) delta_pct_millionths,
               case when l_linenumber % 2 = 0 then false else abs(l_linenumber - 3) * 100000000::hugeint * 100 >= 101 * cents end passes,
               case when l_linenumber % 2 = 0 then abs(l_linenumber - 3) * 100000000000000000000::hugeint >= 3 * cast(l_partkey || '1000000000000000000000' as hugeint) else l_linenumber <> 3 end passes_fine
               from (select *, cast(cast(l_extendedprice as decimal(18,2)) * 100 as hugeint) cents from lineitem join orders on l_orderkey = o_orderkey)""",
    "as_of_join_hot_keys": f"""with {_ALL}, w as (select * from f qualify row_number() over (partition by cd_conta, knowledge_date order by source_doc_version desc, fact_id) = 1),
        p as (select o_orderkey, ['A', 'N', 'R'][cast(o_orderkey % 3 + 1 as int)] cd_conta, cast(o_orderdate as date) as_of from orders)
        select o_orderkey, p.cd_conta, fact_id, cast(v as double) as value, cast(knowledge_date as varchar) knowledge_date from p asof left join w on p.cd_conta = w.cd_conta and p.as_of >= w.knowledge_date""",
    "as_of_panel_many_days": f"""with {_OK}, o as (select * from g qualify row_number() over (partition by {_KEY}, knowledge_date order by source_doc_version desc, fact_id) = 1),
        i as (select *, lead(knowledge_date) over (partition by {_KEY} order by knowledge_date) until from o), d as (select cast(date '1992-01-01' + cast(10 * n as int) as date) as_of from range(256) r(n))
        select cast(as_of as varchar) as_of, cd_conta, count(*) known, cast(sum(source_doc_version) as bigint) versions, cast(sum(v) as double) total
        from i join d on as_of >= knowledge_date and (until is null or as_of < until) group by 1, 2""",
    "appended_by_batches": f"with {_OK} select {_FACT} from g",
    "ingest_outcomes": f"""with {_SEEN}, t as (select *, row_number() over (partition by content_sha256 order by retrieved_at % 3 > 0, retrieved_at, retrieval_id) n from e where content_sha256 is not null)
        select retrieval_id, resource_key, content_sha256, n = 1 is_new from t""",
}
ORACLES |= {"laid_out_reads": ORACLES["as_of_single_key"], "validity_by_batches": ORACLES["validity_intervals"], "restatements_by_batches": ORACLES["restatements_all"]}
