"""The SQL that the registered queries must agree with, for DuckDB over the driver's tables."""

from __future__ import annotations

from evigraph.catalog import BUCKETS, DSL, TRADE_SQL

ORDERS_SQL = """with o as (select 'o-' || o_orderkey as id, o_orderkey as k, o_custkey as c, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'proposed' end as status, o_orderdate::date as day, o_totalprice as value from orders)"""

LOG_HEAD = """with log as (select 'u-' || user_id as id, event_id as pos, strftime(ts, '%Y-%m-%dT%H:%M:%S') as moment, event_type, value, case event_type when 'error' then 'withdraw' when 'purchase' then 'retire' else 'assert' end as op, 'error ' || event_id as why, 'u-buyer' as into_id from events)"""

LOG_TAIL = """,
ranked as (select *, row_number() over (partition by id order by moment, pos) as n from log),
base as (select id, min(case when n = 1 then pos end) as first_pos, max(case when op = 'assert' then n end) as a, max(case when op = 'withdraw' then n end) as w, max(case when op = 'retire' then n end) as r from ranked group by id)
select b.id, x.event_type as claim, case when b.w > b.a then 'withdrawn' end as status, case when b.w > b.a then y.why end as reason, case when b.r > b.a then z.into_id end as same_as, b.first_pos
from base b join ranked x on x.id = b.id and x.n = b.a left join ranked y on y.id = b.id and y.n = b.w left join ranked z on z.id = b.id and z.n = b.r where b.a is not null"""

EVIDENCE_SQL = f"""with src as (select 'd-' || doc_id as id, doc_id, source as doc, regexp_extract(source, '([0-9]+)$', 1)::int % 8 as cl, case when doc_id % 3 = 0 then 'p-' || (doc_id % 5) end as speaker from documents),
sources as (select *, case when cl < 7 then 6 - cl end as rank from src),
claims as (select 'k-' || k as id, k, case when k % 11 = 0 then 'withdrawn' else 'asserted' end as status, case when k % 13 = 0 then 'two facts' end as under, case when k % 4 = 0 then '2021-01-01' end as vf, case when k % 4 = 1 then '2021-01-01' end as vu from range({BUCKETS}) t(k)),
attests as (select 'd-' || doc_id as src, 'k-' || (doc_id % {BUCKETS}) as dst from labels where quality = 1),
against as (select 'd-' || doc_id as src, 'k-' || (doc_id % {BUCKETS}) as dst from labels where quality = 0 and toxic = 1),
rival as (select 'k-' || k as src, 'k-' || ((k + 1) % {BUCKETS}) as dst, k % 2 = 0 as one_way from range({BUCKETS}) t(k) where k % 3 = 0),
verdict as (select 'k-' || (doc_id % {BUCKETS}) as fact, 'd-' || doc_id as source, case when toxic = 1 then 'unsupported' else 'confirmed' end as verdict, case when doc_id % 4 <> 1 then 'reader' end as by_who, doc_id % 2 = 1 as machine from labels)"""

TURNS_SQL = """with recursive t as (select distinct conv_id, turn, 't-' || conv_id || '-' || turn as id from conversations),
req as (select id as src, 't-' || conv_id || '-' || (turn - 1) as dst from t where turn > 0)"""

_FILES = """with sources as (select 'd-' || doc_id as id, case when doc_id % 31 <> 0 then 'a/' || doc_id end as path from documents),
old as (select 'a/' || doc_id as path, sha256(text) as hash, octet_length(encode(text))::bigint as size from documents where doc_id % 9 <> 0),
new as (select case when doc_id % 7 = 0 then 'b/' else 'a/' end || doc_id as path, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as hash, octet_length(encode(case when doc_id % 5 = 0 then text || '!' else text end))::bigint as size from documents where doc_id % 8 <> 0),
status as (select s.id, s.path, case when s.path is null then 'outside-project' when n.hash is null and o.hash is not null then 'vanished' when n.hash is null then 'not-found' when o.hash is null then 'unrecorded' when o.hash <> n.hash then 'changed' else 'ok' end as state
  from sources s left join old o on o.path = s.path left join new n on n.path = s.path)"""

_NORM = r"""array_to_string(list_transform(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''), lambda x: trim(x, '.,;:!?"''()[]')), ' ')"""
_TOKENS = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda x: octet_length(encode(x)) > 1))"
_FOLD = r"regexp_replace(regexp_replace(lower({0}), '\*[0-9]+', '', 'g'), '[^\p{{L}}\p{{Nd}}]', '', 'g')"

_GROUPS = ORDERS_SQL + """, m as (select 'g-' || c as id, c, count(*) as total, count(*) filter (where status in ('open', 'done')) as satisfied, sum(value) as value from o group by c)"""
_RULE = "case c % 7 when 0 then total > 0 and satisfied = total when 1 then satisfied >= 1 when 2 then satisfied = 0 when 3 then satisfied >= 2 when 4 then satisfied < 3 when 5 then satisfied = 1 else total > 0 end"
_STOP = """'about', 'after', 'again', 'against', 'also', 'back', 'because', 'been', 'before', 'being', 'both', 'came', 'come', 'could', 'did', 'does', 'down', 'each', 'even', 'ever', 'every', 'from', 'gave', 'give', 'goes', 'gone', 'had', 'has',
'have', 'here', 'how', 'into', 'just', 'know', 'like', 'made', 'make', 'many', 'more', 'most', 'much', 'must', 'near', 'need', 'never', 'next', 'not', 'now', 'only', 'onto', 'other', 'our', 'out',
'over', 'own', 'said', 'same', 'says', 'she', 'should', 'since', 'some', 'such', 'take', 'than', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'they', 'this', 'those',
'through', 'time', 'under', 'upon', 'very', 'was', 'well', 'went', 'were', 'what', 'when', 'where', 'which', 'while', 'who', 'will', 'with', 'would', 'your'"""

_HASH = "substr(sha256({0}), 1, 16)"

#: Each run of an equal digit as one digit.
_RUNS = "{}"
for _d in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"

SQL = {
    "q_sort_topk": ORDERS_SQL + " select id, ord from (select id, row_number() over (order by value desc, id) as ord from o) where ord <= 50",
    "q_sort_nulls_last": TRADE_SQL + " select id, ord from (select id, row_number() over (order by unit is null, unit desc, id) as ord from nodes where kind = 'entity') where ord <= 40",
    "q_group_state": _GROUPS + f" select id, total, satisfied, total - satisfied as blocking, {_RULE} as ok from m",
    "q_group_sum": _GROUPS + " select id, round(value, 2) as value from m where c % 7 = 6",
    "q_fold": LOG_HEAD + LOG_TAIL,
    "q_stream_refold": LOG_HEAD + LOG_TAIL,
    "q_latest_record": "select user_id, event_type, arg_max(value, event_id) as last_value, max(event_id) as event_id from events group by all",
    "q_derived_date": ORDERS_SQL + """, a as (select k, date_trunc('month', day) as m, day(day) as dd, day from o),
b as (select k, (m + to_months((k % 5 + 1)::int))::date + (dd - 1)::int as d1 from a), c as (select k, d1 - 10 as d2 from b),
d as (select k, (date_trunc('month', d2) + to_months(12))::date + (day(d2) - 1)::int as d3 from c)
select 'd-' || k as id, strftime(d3, '%Y-%m-%d') as "at" from d union all select 'f-' || k, strftime(d3 + 180, '%Y-%m-%d') from d""",
    "q_derived_value": "select 'v-' || o_orderkey as id, round(o_totalprice - c_acctbal + 3, 2) as value from orders join customer on c_custkey = o_custkey",
    "q_alias_asof": """with e as (select event_id, 'user ' || user_id as name, strftime(ts, '%Y-%m-%dT%H:%M:%S') as t from events where event_type = 'signup'),
w as (select name, 'e-' || event_id as id, t as f, lead(t) over (partition by name order by t, event_id) as u from e),
r as (select 'user ' || user_id as ref, strftime(ts, '%Y-%m-%dT%H:%M:%S') as moment from events where event_type = 'error')
select ref, moment as "at", coalesce((select id from w where w.name = ref and f <= moment and (u is null or moment < u)), ref) as id, (select count(*) from w where w.name = ref and f <= moment and (u is null or moment < u)) as n from r""",
    "q_tension": EVIDENCE_SQL + """, f as (select dst as id, count(*) as n_for, max(rank) as best, min(case when speaker is not null then rank end) as weakest from attests join sources on sources.id = src group by dst),
g as (select dst as id, count(*) as n from against group by dst),
faced as (select dst as id, src as other from rival union all select src, dst from rival where not one_way),
p as (select x.id, x.other, fo.best as o_best, fi.weakest from faced x join claims a on a.id = x.id join claims b on b.id = x.other and b.status in ('asserted', 'proposed') join f fo on fo.id = x.other left join f fi on fi.id = x.id
  where not coalesce(a.vu <= b.vf, false) and not coalesce(b.vu <= a.vf, false)),
h as (select id, count(*) as n, count(distinct case when o_best > weakest then other end) as beaten from p group by id),
t as (select c.id, coalesce(n_for, 0) as n_for, coalesce(g.n, 0) + coalesce(h.n, 0) as n_against, coalesce(beaten, 0) as n_beaten, under from claims c left join f using (id) left join g using (id) left join h using (id) where c.status <> 'withdrawn')
select id, case when under is not null then 'underdetermined' when n_beaten > 0 then 'impeached' else 'disputed' end as tension, n_for, n_against, n_beaten from t where under is not null or (n_for > 0 and n_against > 0)""",
    "q_pending": EVIDENCE_SQL + " select distinct dst as fact, src as source from attests where dst not in (select id from claims where status = 'withdrawn') and (dst, src) not in (select (fact, source) from verdict where by_who is not null and not machine)",
    "q_verdict_report": EVIDENCE_SQL + " select verdict, count(*) as n, '2024-01-01' as last_at from verdict group by verdict",
    "q_check_unsourced": EVIDENCE_SQL + ", bad as (select fact, source from verdict where verdict = 'unsupported' and by_who is not null and not machine), ok as (select dst from attests a where not exists (select 1 from bad where bad.fact = a.dst and bad.source = a.src)) select id, 'unsourced' as \"check\", 'warn' as severity from claims where status = 'asserted' and id not in (select dst from ok)",
    "q_check_source_hygiene": EVIDENCE_SQL + ", used as (select src as id from attests union select src from against) select 'source' as \"check\", 'error' as severity, 'its class needs a speaker' as message, count(*) as n from sources where cl in (1, 5) and speaker is null having count(*) > 0 union all select 'unreferenced', 'warn', 'is used nowhere', count(*) from sources where id not in (select id from used) having count(*) > 0",
    "q_check_dangling": "with c as (select 'c-' || c_custkey as id from customer where c_custkey % 10 <> 3), o as (select 'c-' || o_custkey as ref from orders) select ref, w || ' names no node: ' || ref as message, count(*) as n from o, (values ('dst'), ('owner')) v(w) where ref not in (select id from c) group by all",
    "q_check_same_file": "select source as doc, count(*) as n, min('d-' || doc_id) as first_id from documents group by source having count(*) > 1",
    "q_taint": TURNS_SQL + ", q as (select id from t where turn = 0 and conv_id % 3 = 0), up(id, question) as (select id, id from q union select req.src, up.question from up join req on req.dst = up.id) select id, question from up",
    "q_closure_chain": TURNS_SQL + ", q as (select id from t where turn = 0 and conv_id % 3 = 0), up(id) as (select src from req where dst in (select id from q) union select req.src from up join req on req.dst = up.id) select id from up where id not in (select id from q)",
    "q_components": "with recursive t as (select distinct conv_id, turn, 't-' || conv_id || '-' || turn as id from conversations), e as (select a.id as a, b.id as b from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn - 1), both_ as (select a, b from e union select b, a from e), r(id, x) as (select a, a from both_ union select r.id, both_.b from r join both_ on both_.a = r.x) select id, min(x) as component from r group by id",
    "q_drifted_reach": EVIDENCE_SQL + " select distinct src as source, dst as id from attests",
    "q_content_ids": TRADE_SQL + " select id, " + _HASH.format("kind || chr(0) || " + _NORM.format("body")) + " as cid from nodes",
    "q_edge_ids": TRADE_SQL + ", e as (select src, dst, 'member_of' as t from member_of union all select src, dst, 'about' from about) select src, dst, " + _HASH.format("src || chr(0) || t || chr(0) || dst") + " as cid from e",
    "q_diff": "with a as (select 'o-' || o_orderkey as id, o_orderstatus || '|' || o_orderpriority as h from orders where o_orderkey % 10 <> 1), b as (select 'o-' || o_orderkey as id, case when o_orderkey % 7 = 0 then 'F' else o_orderstatus end || '|' || o_orderpriority as h from orders where o_orderkey % 10 <> 2) select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as movement from a full join b on a.id = b.id where a.h is distinct from b.h",
    "q_profile": EVIDENCE_SQL + """, used as (select src as id from attests union select dst from attests union select src from against union select dst from against union select src from rival union select dst from rival),
cited as (select c.id, least(count(a.src), 5) as n from claims c left join attests a on a.dst = c.id group by c.id)
select 'kind' as measure, 'source' as item, count(*) as n from sources union all select 'kind', 'claim', count(*) from claims
union all select 'class', ['record', 'admission', 'document', 'observation', 'statement', 'interested', 'inference', 'authority'][cl + 1], count(*) from sources group by cl
union all select 'citations', n::varchar, count(*) from cited group by n
union all select 'unreferenced', 'source', count(*) from sources where id not in (select id from used) having count(*) > 0
union all select 'contradictions', 'edge', (select count(*) from against) + (select count(*) from rival)
union all select 'withdrawn', 'node', count(*) from claims where status = 'withdrawn'""",
    "q_set_proportion": "select count(*) filter (where o_totalprice > 100000) as n, count(*) as total, count(*) filter (where o_totalprice > 100000) * 100 // count(*) as percent from orders",
    "q_exact_dupes": "select min('d-' || doc_id) as first_id, count(*) as n from documents where text is not null group by " + _NORM.format("text") + " having count(*) > 1",
    "q_near_dupes": "with raw as (select 'd-' || doc_id as id, text, " + _NORM.format("text") + " as norm from documents where text is not null), first as (select min(id) as id from raw group by norm), d as (select id, " + _TOKENS.format("text") + """ as t from raw where id in (select id from first)),
e as (select id, len(t) as size, unnest(t) as token from d), df as (select token, count(*) as df from e group by token),
r as (select id, size, token, row_number() over (partition by id order by df, token) as k from e join df using (token)),
p as (select distinct x.id as a, y.id as b from r x join r y on x.token = y.token and x.id < y.id where x.k <= 3 and y.k <= 3),
s as (select p.a, p.b, len(list_intersect(x.t, y.t)) as i, len(x.t) + len(y.t) as n from p join d x on x.id = p.a join d y on y.id = p.b)
select a, b, round(i / (n - i), 6) as score from s where i / (n - i) >= 0.72""",
    "q_rare_tokens": "with d as (select 'b-' || item_id as id, " + _TOKENS.format("text") + " as t from benchmark), e as (select id, len(t) as size, unnest(t) as token from d), df as (select token, count(*) as df from e group by token) select id, size, token from (select id, size, token, row_number() over (partition by id order by df, token) as k from e join df using (token)) where k <= 3",
    "q_quote_homes": "with q as (select distinct " + _FOLD.format("text") + " as fold from benchmark), d as (select 'd-' || doc_id as path, " + _FOLD.format("text") + " as f from documents) select md5(fold) as quote, path from q join d on contains(f, fold) where length(fold) >= 24",
    "q_identifiers": r"""with m as (select doc_id, list_concat(list_concat(regexp_extract_all(text, '(?i)\bAF\s*#?\s*\d{8,14}\b'), regexp_extract_all(text, '(?i)\bPL\s*\d{2}\s*-\s*\d{4}\b')), list_concat(regexp_extract_all(text, '(?i)\bForm\s+\d{1,3}\s*[A-Z]?\b'), regexp_extract_all(text, '\d{8,14}'))) as x from documents)
select distinct doc_id, identifier from (select doc_id, regexp_replace(lower(unnest(x)), '[^a-z0-9]', '', 'g') as identifier from m) where identifier <> ''""",
    "q_content_terms": f"select distinct item_id, term from (select item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as term from benchmark) where case when regexp_full_match(term, '[0-9]+') then length(term) >= 2 else length(term) >= 4 end and term not in ({_STOP})",
    "q_fold_text": "select item_id, md5(" + _FOLD.format("text") + ") as folded, len(" + _TOKENS.format("text") + ") as n_tokens from benchmark",
    "q_source_status": _FILES + " select id, path, state from status",
    "q_relocate": _FILES + " select s.id, s.path as old, case when count(*) = 1 then min(n.path) end as new, count(*) as candidates from status s join old o on o.path = s.path join new n on n.hash = o.hash and n.size = o.size where s.state = 'vanished' group by s.id, s.path",
    "q_backlog": EVIDENCE_SQL + ", docs as (select distinct 'src' || (regexp_extract(source, '([0-9]+)$', 1)::int + 3) as path from documents), f as (select doc, count(distinct dst) as n from attests join sources s on s.id = src group by doc), s as (select distinct doc from sources) select coalesce(docs.path, s.doc) as path, case when docs.path is null then 'missing' when s.doc is null then 'unread' when coalesce(n, 0) < 2 then 'thin' else 'read' end as state, coalesce(n, 0) as facts from docs full join s on s.doc = docs.path left join f on f.doc = s.doc",
    "q_alias_conflicts": """with n as (select 'name ' || o_custkey as name, 'o-' || o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as f, strftime(o_orderdate::date + 200, '%Y-%m-%d') as u from orders),
w as (select *, max(u) over (partition by name order by f, u, id rows between unbounded preceding and 1 preceding) as before from n) select name, count(*) as n, count(*) filter (where f < before) as overlaps from w where before is not null group by name""",
    "q_name_keys": """with w as (select p_partkey, list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: case when length(regexp_replace(x, '[^a-z]', '', 'g')) < 3 or regexp_matches(x, '[0-9]') then ''
else substr(x, 1, 1) || translate(x, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202') end) as ks from part),
r as (select p_partkey, list_transform(ks, lambda x: case when x = '' then '' else substr(substr(x, 1, 1) || replace(substr(""" + _RUNS.format("substr(x, 2)") + """, 2), '0', ''), 1, 6) end) as ks from w)
select p_partkey, case when len(ks) > 0 and not list_contains(ks, '') then array_to_string(ks, ' ') end as keys from r""",
    "q_edge_dedupe": "select 'o-' || l_orderkey as src, count(distinct l_partkey) as n from lineitem group by l_orderkey",
}

#: Not in SQL: a rule over cycles and the longest common subsequence.
ORACLE_SQL = {**{name: TRADE_SQL + sql for name, (_, sql) in DSL.items()}, **SQL}

