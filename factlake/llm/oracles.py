"""SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_templates import TEMPLATES
from .licenses import PHRASES, mandatory, may_be_empty, parse

_WORD = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
with n as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) size,
         md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) k
  from documents),
s as (
  select source, sum(size) source_size, row_number() over (order by source nulls last) - 1 r from n group by source),
w as (
  select *, cast(case r % 3 when 0 then 5 when 1 then 2 else 1 end as double) weight, cast(source_size as double) * 2 cap,
         cast(sum(source_size) over () as double) * 1.5 budget from s),
l as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, r rows between current row and unbounded following) lev,
         row_number() over (order by cap / weight, r) place from w),
f as (select min_by(lev, place) lev from l where cap > lev * weight),
t as (
  select source, source_size, case when l.cap > l.lev * weight then weight * f.lev else cap end target from l left join f on true),
e as (
  select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 2) else 0 end epochs from t),
p as (
  select n.*, e.source_size, e.target, e.epochs, greatest(cast(floor(e.target - e.epochs * e.source_size) as bigint), 0) rest,
         sum(size) over (partition by n.source order by k) upto, sum(size) over (partition by n.source, k) ks
  from n join e on n.source is not distinct from e.source)
select doc_id, cast(size as bigint) size, cast(source_size as bigint) source_size, target,
       cast(epochs * size + case when upto <= rest then size when upto - ks <= rest and ks > 0
            then ((rest - upto + ks) * size) // ks else 0 end as bigint) taken
from p
"""

OP9 = """
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end tail from pages),
h as (
  select page_id, lower(regexp_extract(tail, '^[^/?#]*')) host, regexp_extract(tail, '^[^/?#]*(/[^?#]*)', 1) path from u),
r(rule_host, rule_path, rule_verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select h.*, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) n
  from h left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, coalesce(host, '') host, coalesce(path, '') path, rule, coalesce(rule_verdict, 'allow') verdict from m where n = 1
"""

OP8 = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
  from documents),
b as (
  select cast(item_id as varchar) item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
  from benchmark),
i as (
  select item_id, list_slice(w, s, s + 12) g from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from b where len(w) > 0)),
k as (select distinct item_id, array_to_string(g, ' ') g, len(g) n from i),
z as (select distinct n from k),
g as (
  select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d join z on len(w) >= n)),
m as (select doc_id, s, g.n, item_id from g join k on g.n = k.n and g.g = k.g),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from m) group by 1),
t as (
  select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

OP11 = rf"""
with d as (
  select *, regexp_extract_all(t, '{_WORD}') w from (select doc_id, coalesce(source, '') part, coalesce("text", '') t from documents)),
l as (select doc_id, max(cast(quality = 1 as int)) good, max(cast(toxic = 1 as int)) toxic from labels group by 1),
b as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
         map(['A', 'B', 'C', 'D', 'E'], [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)]) fails
  from d left join l on d.doc_id = l.doc_id),
c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from b group by 1, 2),
x(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (
  select a.f || b.f || c.f || d.f || e.f filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, cast(step as int) step, filter_order[step] own, string_split(left(filter_order, step - 1), '') earlier, string_split(replace(filter_order, filter_order[step], ''), '') others from o, range(1, 6) r(step)),
h as (
  select s.filter_order, s.step, s.own, c.part, c.n, c.good, c.toxic, fails[own] failing,
         len(list_filter(earlier, lambda f: f <> '' and fails[f])) > 0 gone, len(list_filter(others, lambda f: fails[f])) > 0 shared
  from s, c),
a as (
  select part, filter_order, step, own, coalesce(sum(n) filter (not gone and not failing), 0) kept, coalesce(sum(n) filter (not gone and failing), 0) removed,
         coalesce(sum(n) filter (gone and failing), 0) redundant, coalesce(sum(n) filter (failing and not shared), 0) unique_fails,
         coalesce(sum(good) filter (not gone and failing), 0) good_lost, coalesce(sum(toxic) filter (not gone and failing), 0) toxic_lost
  from h group by all)
select part, filter_order, step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
       cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) shapley
from a
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit: a byte is taken in where the list has one, else a bit goes out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {steps}), lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, (c & 1) * 3988292384) end))"


def _leaf(columns: dict[str, str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns.values()) + ")"


def _tree(name: str, leaves: str) -> str:
    """name: g, lev, idx, n, h of all nodes above (and with) the leaves (g, idx, n, h)."""
    return f"""{name}(g, lev, idx, n, h) as (
  select g, 0, idx, n, h from {leaves}
  union all
  select g, max(lev) + 1, idx // 8, max((n + 7) // 8), sha256(string_agg(h, '' order by idx)) from {name} where n > 1 group by g, idx // 8)"""


_SIBLINGS = "coalesce(string_agg(s.h, '' order by s.idx) filter (s.idx {0} a.idx), '')"
_COLUMNS = {"doc_id": "cast(doc_id as varchar)", "source": "source", "lang": "lang", "n_chars": "cast(n_chars as varchar)", "text": '"text"'}
OP12 = f"""
with recursive d as (
  select *, {_leaf(_COLUMNS)} leaf, {_leaf(_COLUMNS | {"text": "changed"})} found, case when lang is null then '-' else '=' || lang end g
  from (select *, case when {_crc32("cast(doc_id as varchar)")} % 3 = 0 then translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else "text" end changed from documents)),
leaves as (select *, leaf h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by g) n from d),
{_tree("t", "leaves")},
tops as (select h subroot, h, t.g lang_key, '' g, row_number() over (order by encode(t.g)) - 1 idx, count(*) over () n from t where n = 1),
{_tree("u", "tops")},
up_t as (
  select a.g, a.lev, a.idx, {_SIBLINGS.format("<")} l, {_SIBLINGS.format(">")} r
  from t a join t s on a.g = s.g and a.lev = s.lev and a.idx // 8 = s.idx // 8 where a.n > 1 group by all),
up_u as (
  select a.lev, a.idx, {_SIBLINGS.format("<")} l, {_SIBLINGS.format(">")} r from u a join u s on a.lev = s.lev and a.idx // 8 = s.idx // 8 where a.n > 1 group by all),
path_u as (select lang_key, subroot, list(struct_pack(l := l, r := r) order by lev) filter (l is not null) p from tops left join up_u on up_u.idx = tops.idx // cast(8 ** lev as bigint) group by all),
path_t as (select leaves.g, leaves.idx, leaf, found, doc_id, list(struct_pack(l := l, r := r) order by lev) filter (l is not null) p from leaves left join up_t on up_t.g = leaves.g and up_t.idx = leaves.idx // cast(8 ** lev as bigint) group by all),
whole as (
  select doc_id, leaf, found, subroot, list_concat(coalesce(path_t.p, []), coalesce(path_u.p, [])) p, (select h from u where n = 1) root from path_t join path_u on path_t.g = path_u.lang_key),
folded as (
  select *, list_reduce(list_prepend(struct_pack(l := found, r := ''), p), lambda a, s: struct_pack(l := sha256(s.l || a.l || s.r), r := '')).l folded_root from whole)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.l || s.r), '')) proof_sha256, folded_root, folded_root = root verified
from folded
"""


def _regex(items: list) -> str:
    """A pattern over words with a space after each, in place of a template's automaton."""
    out = ""
    for x in items:
        if isinstance(x, bytes):
            out += x.decode() + " "
        elif x[0] == "optional":
            out += f"(?:{_regex(x[1])})?"
        else:
            word = "[^ ]+" if x[3] == ".+" else f"(?:{x[3]})"
            out += f"(?:{word} ){{{x[1]},{x[2]}}}"
    return out


def _accepted() -> str:
    rows = []
    for label, given in TEMPLATES.items():
        for template in given:
            items = parse(template)
            while may_be_empty(items[0]):
                items = items[1:]
            rows.append(f"case when regexp_matches(j, ' {_regex(items)}') then struct_pack(label := '{label}', n := {len(mandatory(items))}) end")
    return ",\n  ".join(rows)


def _standing(phrase: str) -> str:
    parts = phrase.split()
    return f"list_filter(range(0, len(w)), lambda i: {' and '.join(f"coalesce(w[i + {k + 1}], '') = '{p}'" for k, p in enumerate(parts))})"


OP13 = rf"""
with t as (
  select doc_id, trim(regexp_replace(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') s from documents),
w as (select doc_id, ' ' || s || ' ' j, case when s = '' then [] else string_split(s, ' ') end w from t),
p as (
  select doc_id, len(w) n_words,
    [{", ".join(f"struct_pack(label := '{label}', n := {len(phrase.split())}, at := {_standing(phrase)})" for phrase, label in PHRASES.items())}] base,
    list_filter([{_accepted()}], lambda x: x is not null) found
  from w),
q as (select *, list_filter(base, lambda b: len(b.at) > 0) b, flatten(list_transform(base, lambda b: b.at)) places from p)
select doc_id, n_words, len(places) n_base, list_min(places) first_word, list_max(places) last_word,
       array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.label))), ',') base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(b, lambda x: x.label), list_transform(found, lambda x: x.label)))), ',') labels,
       case when n_words = 0 then 0.0::double else coalesce(greatest(list_max(list_transform(b, lambda x: x.n)), list_max(list_transform(found, lambda x: x.n))), 0)::double / n_words end score
from q
"""

ORACLES = {"op7_mixing": OP7, "op8_decontamination": OP8, "op9_url_filters": OP9, "op11_filter_audit": OP11, "op12_manifest": OP12, "op13_licenses": OP13}
