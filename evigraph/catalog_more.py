"""Further registered queries: checks, recorded answers, writes, entries, quotations and attestation, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.catalog import TRADE_SQL, edge, evidence, event_log, key, node, order_day, order_nodes, order_status, table, trade, turns, verdicts, _folded, _union
from evigraph.catalog_sql import EVIDENCE_SQL, LOG_HEAD, LOG_TAIL, ORDERS_SQL, SQL, TURNS_SQL
from evigraph.functions import text
from evigraph.operators import attest, checks, closure, dedupe, derive, entries, fold, graph, have, pins, provenance, quotes
from evigraph.plans.compile import Graph, load

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function as a query with the SQL it must agree with."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def placed(rows: DataFrame, most: int) -> DataFrame:
    """(id, ord): the first rows of an ordered answer with their places: a report for people."""
    return rows.limit(most).select("id", (F.monotonically_increasing_id() + 1).alias("ord"))


def findings(rows: DataFrame) -> DataFrame:
    """Findings with their subjects as one text."""
    return rows.select("check", "severity", F.array_join("subjects", " ").alias("subjects"), "message")


def constant(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- order, windows, gates, dated edges


@query(ORDERS_SQL + " select id, ord from (select id, row_number() over (order by value desc, id) as ord from o where status = 'open') where ord <= 200")
def q_rows_in_order(spark, d):
    return placed(trade(spark, d).rows("action[status=open] sort value desc, id"), 200)


@query(TRADE_SQL + " select id, ord from (select id, row_number() over (order by id) as ord from nodes where kind = 'entity' or status = 'done') where ord <= 300")
def q_set_order(spark, d):
    return placed(trade(spark, d).rows("!(action[status!=done])"), 300)


@query(ORDERS_SQL + " select id, ord from (select id, row_number() over (order by value, id) as ord from o where status in ('open', 'done') and strftime(day, '%Y-%m-%d') <= '1996-06-30') where ord <= 150")
def q_scoped_sort(spark, d):
    return placed(trade(spark, d).rows("(action[status=open] | action[status=done]) @1996-06-30 sort value, id"), 150)


def _moments(spark, d) -> Graph:
    """Events by day, every third by its month only, every seventh by its year."""
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    at = F.when(F.col("event_id") % 7 == 0, F.substring(day, 1, 4)).when(F.col("event_id") % 3 == 0, F.substring(day, 1, 7)).otherwise(day)
    nodes = node(e, id=key("e-", "event_id"), kind=F.lit("event"), body=F.col("event_type"), at=at, value=F.col("value"))
    g = Graph(nodes, edge(e, F.lit("x"), "about", F.lit("y")).limit(0), closed=True)
    g._kept["gated"] = False
    return g


_MOMENTS = """with e as (select 'e-' || event_id as id, case when event_id % 7 = 0 then strftime(ts, '%Y') when event_id % 3 = 0 then strftime(ts, '%Y-%m') else strftime(ts, '%Y-%m-%d') end as moment from events),
w as (select id, case length(moment) when 4 then moment || '-01-01' when 7 then moment || '-01' else moment end as lo, case length(moment) when 4 then moment || '-12-31' when 7 then moment || '-31' else moment end as hi from e)"""


@query(_MOMENTS + " select id from w where hi >= '2024-01-05' and lo <= '2024-01-12'")
def q_window(spark, d):
    return _moments(spark, d).eval("event @[2024-01-05,2024-01-12]")


@query(_MOMENTS + " select id from w where hi >= '2023-11-01' and lo <= '2024-01-31'")
def q_window_months(spark, d):
    return _moments(spark, d).eval("event @[2023-11,2024-01]")


def _dated(spark, d) -> Graph:
    """Orders about their customers for 90 days; every fifth relation waits for the order before it."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    nodes = order_nodes(o, valid_from=F.lit(None)).unionByName(node(c, id=key("c-", "c_custkey"), kind=F.lit("entity"), unit=F.col("c_mktsegment"), status=F.lit("asserted")))
    until = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 90), "yyyy-MM-dd")
    gate = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("o-"), (F.col("o_orderkey") - 1).cast("string")))
    edges = edge(o, key("o-", "o_orderkey"), "about", key("c-", "o_custkey"), valid_from=order_day(), valid_until=until, **{"while": gate})
    return Graph(nodes, edges, closed=True)


@query(ORDERS_SQL + """, e as (select a.id, a.k from o a join customer on c_custkey = a.c and c_mktsegment = 'BUILDING' where strftime(day, '%Y-%m-%d') <= '1996-06-30' and strftime(day + 90, '%Y-%m-%d') >= '1996-06-30')
select id from e where k % 5 <> 0 or k - 1 in (select k from o where status = 'done')""")
def q_dated_edges(spark, d):
    return _dated(spark, d).eval("action -about-> entity[unit=BUILDING] @1996-06-30")


@query(ORDERS_SQL + ", p as (select *, strftime(day, '%Y-%m-%d') <= '1997-01-01' as there from o) select a.id from p a where there and (a.k % 4 <> 0 or exists (select 1 from p b where b.k = a.k - 1 and b.status = 'done' and b.there))")
def q_while_gate(spark, d):
    """Every fourth order holds only while the order before it does."""
    o = table(spark, d, "orders")
    gate = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("o-"), (F.col("o_orderkey") - 1).cast("string")))
    return Graph(order_nodes(o, **{"while": gate}), edge(o, F.lit("x"), "about", F.lit("y")).limit(0), closed=True).eval("action @1997-01-01")


@query(ORDERS_SQL + """, g as (select 'g-' || c as id, c, count(*) as total, count(*) filter (where status = 'done') as sat from o group by c)
select id, status = 'done' as ok from o union all
select id, case c % 4 when 0 then total > 0 and sat = total when 1 then sat >= 1 when 2 then sat >= 3 else sat = 0 end from g""")
def q_satisfied(spark, d):
    """Whether each order and each group of a customer's orders holds."""
    o = table(spark, d, "orders")
    rule = F.element_at(F.array(*map(F.lit, ("all", "any", ">= 3", "none"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    nodes = order_nodes(o, valid_from=F.lit(None)).unionByName(node(o.select("o_custkey").distinct(), id=key("g-", "o_custkey"), kind=F.lit("group"), group_expr=rule))
    return derive.satisfied(nodes, edge(o, key("o-", "o_orderkey"), "member_of", key("g-", "o_custkey")))


@query(ORDERS_SQL + " select 'd-' || k as id, strftime(day + 30, '%Y-%m-%d') as \"at\" from o where k % 3 <> 0")
def q_derived_needs_full_date(spark, d):
    """A third of the orders has a month only: nothing can be derived from these."""
    o = table(spark, d, "orders")
    base = order_nodes(o, at=F.when(F.col("o_orderkey") % 3 == 0, F.substring(order_day(), 1, 7)).otherwise(order_day()))
    moved = node(o, id=key("d-", "o_orderkey"), kind=F.lit("event"), at_expr=F.concat(F.lit("="), key("o-", "o_orderkey"), F.lit(".at + 30d")))
    return derive.dates(base.unionByName(moved)).where(F.col("id").startswith("d-"))


_TENSE = SQL["q_tension"]


@query("select id from (" + _TENSE + ") where tension = 'disputed'")
def q_flag_disputed(spark, d):
    return Graph(*evidence(spark, d)).eval("claim[disputed]")


@query(EVIDENCE_SQL + " select dst as id from rival where src = 'k-3' union select src from rival where dst = 'k-3'")
def q_undirected_contradiction(spark, d):
    """A hop without a direction ignores that an edge is one-way."""
    return Graph(*evidence(spark, d)).eval("claim -contradicts- #k-3")


@query(TURNS_SQL + ", near as (select 0 as k union all select 1 union all select 2) select distinct t.id from t, near where conv_id = 1 and turn between 0 and 3")
def q_neighbourhood(spark, d):
    _, edges = turns(spark, d)
    return closure.neighbourhood(edges, "t-1-1", 2)[0].select("id")


# ---------------------------------------------------------------- writes


_WRITES = """, extra as (select * from (values ('u-1', 900001, '2030-01-01T00:00:00', 'own claim', 7.5, 'assert', null, null), ('u-2', 900002, '2030-01-01T00:00:00', null, null, 'withdraw', 'out of date', null), ('u-3', 900003, '2030-01-01T00:00:00', null, null, 'retire', null, 'u-1'),
  ('u-4', 900004, '2030-01-01T00:00:00', null, null, 'withdraw', 'wrong', null), ('u-900', 900005, '2030-01-01T00:00:01', 'put right', null, 'assert', null, null)) v(id, pos, moment, event_type, value, op, why, into_id)),
log as (select id, pos, moment, event_type, value, op, 'error ' || pos as why, 'u-buyer' as into_id from log0 union all select * from extra)"""


@query(LOG_HEAD.replace("with log as", "with log0 as") + _WRITES + LOG_TAIL)
def q_written_log(spark, d):
    """An assertion, a withdrawal, a retirement and a correction after the log, then the fold."""
    at = "2030-01-01T00:00:00"
    new = [fold.asserting(spark, "u-1", {"claim": "own claim", "value": "7.5"}, "me", at), fold.withdrawing(spark, "u-2", "out of date", "me", at), fold.retiring(spark, "u-3", "u-1", "me", at), fold.correcting(spark, "u-4", "wrong", "u-900", {"claim": "put right"}, "me", at)]
    log = event_log(spark, d)
    for k, rows in enumerate(new):
        log = log.unionByName(rows.withColumn("pos", F.col("pos") + 900001 + k))
    return _folded(fold.fold(log))


@query(LOG_HEAD + """, last as (select id, arg_max(event_type, (moment, pos)) as claim from log where op = 'assert' group by id)
select id, claim, 'checked' as status, null as value from last where id = 'u-5'""")
def q_amended(spark, d):
    """A node's last fields with one changed and one dropped."""
    rows = fold.amending(event_log(spark, d), "u-5", {"status": "checked", "value": None}, "me", "2030-01-01")
    return rows.select("id", *(F.element_at("fields", F.lit(k)).alias(k) for k in ("claim", "status", "value")))


@query(LOG_HEAD + ", first as (select id, min((moment, pos)) as f from log where op = 'assert' group by id) select l.id, l.op, l.moment as \"at\" from log l left join first on first.id = l.id where l.op <> 'assert' and (f is null or (l.moment, l.pos) < f)")
def q_ignored_acts(spark, d):
    return fold.ignored_acts(event_log(spark, d))


@query("""select 'o-' || o_orderkey as id, case o_orderkey % 4 when 0 then '["d-1","d-2","d-9"]' when 1 then '["d-2","d-9"]' when 2 then '["d-7","d-2","d-9"]' else '["d-2", "d-9"]' end as cites from orders""")
def q_merged_citations(spark, d):
    """Citations added to lists, to a single one and to none; what is there keeps its text."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, '["d-1","d-2"]').when(k == 1, "").when(k == 2, "d-7").otherwise('["d-2", "d-9"]')
    rows = table(spark, d, "orders").select(key("o-", "o_orderkey").alias("id"), F.create_map(F.lit("attested_by"), said).alias("fields"))
    return fold.merge_citations(rows, ["d-2", "d-9"]).select("id", F.element_at("fields", F.lit("attested_by")).alias("cites"))


# ---------------------------------------------------------------- entries


def _entries(spark, d) -> DataFrame:
    """Orders as folded fields: lists and single relations, structs with dates, partial dates, numbers, expressions and aliases."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    about = F.when(k % 3 == 0, key("#c-", "o_custkey")).when(k % 3 == 1, F.concat(F.lit('["'), key("c-", "o_custkey"), F.lit('",{"id":"#r-1","valid_from":"1995","because":" why "}]')))
    fields = F.map_filter(
        F.create_map(
            F.lit("action"), key("order ", "o_orderkey"), F.lit("status"), order_status(), F.lit("owner"), key("c-", "o_custkey"), F.lit("about"), about,
            F.lit("at"), F.when(k % 4 == 0, F.substring(order_day(), 1, 7)).when(k % 4 == 1, F.lit("= o-1.at + 3d")).otherwise(order_day()),
            F.lit("value"), F.when(k % 5 == 0, F.lit("= o-1.value + 2")).when(k % 5 == 1, F.lit("12.50")).when(k % 5 == 2, F.lit("many")),
            F.lit("aliases"), F.when(k % 7 == 0, F.concat(F.lit('["A'), k.cast("string"), F.lit('",{"as":"B","from":"1996"}]'))),
            F.lit("answered_by"), F.when(k % 6 == 0, F.lit("o-1")), F.lit("undercut_by"), F.when(k % 6 == 1, F.lit("o-2")), F.lit("derived_from"), F.when(k % 8 == 0, F.lit('["d-1","d-2"]')), F.lit("colour"), F.when(k % 9 == 0, F.lit("red")),
        ),
        lambda _, v: v.isNotNull(),
    )
    own = o.select(key("o-", "o_orderkey").alias("id"), fields.alias("fields"), k.cast("long").alias("pos"))
    alone = o.where("o_orderkey % 10 = 0").select(key("x-", "o_orderkey").alias("id"), F.create_map(F.lit("from"), key("#o-", "o_orderkey"), F.lit("to"), F.lit("n-1"), F.lit("is"), F.when(F.col("o_orderkey") % 20 == 0, "members").otherwise("supports")).alias("fields"), (k + 10**9).cast("long").alias("pos"))
    return own.unionByName(alone)


@query("""select 'o-' || o_orderkey as id, 'action' as kind, 'order ' || o_orderkey as body, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'proposed' end as status, 'c-' || o_custkey as owner,
case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m') when 1 then null else strftime(o_orderdate, '%Y-%m-%d') end as moment, case when o_orderkey % 4 = 1 then '= o-1.at + 3d' end as at_expr, case o_orderkey % 4 when 0 then 'month' else 'day' end as "precision",
case when o_orderkey % 5 = 1 then 12.5 end::double as value, case when o_orderkey % 5 = 0 then '= o-1.value + 2' end as value_expr, case when o_orderkey % 7 = 0 then 'A' || o_orderkey || ' B@1996' else '' end as names, case when o_orderkey % 8 = 0 then 'd-1 d-2' else '' end as premises from orders""")
def q_parsed_nodes(spark, d):
    n = entries.nodes(_entries(spark, d))
    names = F.array_join(F.transform("aliases", lambda a: F.concat_ws("@", a["as"], a["from"])), " ")
    return n.select("id", "kind", "body", "status", "owner", F.col("at").alias("moment"), "at_expr", "precision", "value", "value_expr", names.alias("names"), F.array_join("premises", " ").alias("premises"))


@query("""with o as (select 'o-' || o_orderkey as id, o_orderkey as k, 'c-' || o_custkey as c from orders)
select id as src, c as dst, 'about' as type, null as valid_from, null as because, false as one_way from o where k % 3 in (0, 1) union all select id, 'r-1', 'about', '1995', 'why', false from o where k % 3 = 1
union all select 'o-1', id, 'answers', null, null, false from o where k % 6 = 0 union all select 'o-2', id, 'contradicts', null, null, true from o where k % 6 = 1
union all select id, p, 'derived_from', null, null, false from o, (values ('d-1'), ('d-2')) v(p) where k % 8 = 0
union all select 'n-1', id, 'member_of', null, null, false from o where k % 20 = 0 union all select id, 'n-1', 'supports', null, null, false from o where k % 20 = 10""")
def q_parsed_edges(spark, d):
    return entries.edges(_entries(spark, d)).select("src", "dst", "type", "valid_from", "because", "one_way")


@query("""select 'entry' as "check", 'error' as severity, 'o-' || o_orderkey as subjects, 'not a number: many' as message from orders where o_orderkey % 5 = 2 union all select 'entry', 'error', 'o-' || o_orderkey, 'unknown field colour' from orders where o_orderkey % 9 = 0""")
def q_entry_faults(spark, d):
    return findings(entries.faults(_entries(spark, d)))


@query(ORDERS_SQL + " select o.id from o join customer on c_custkey = c where status = 'open' and c_mktsegment = 'BUILDING'")
def q_loaded_log(spark, d):
    """A log of orders and customers, folded, parsed, merged and queried: three records of the same customer are one in the end."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    none = F.lit(None).cast("string")
    row = lambda df, i, fields, pos: df.select(F.lit("assert").alias("op"), i.alias("id"), fields.alias("fields"), none.alias("reason"), none.alias("into_id"), none.alias("note"), F.lit("me").alias("by_who"), F.lit("2024-01-01").alias("at"), pos.cast("long").alias("pos"))
    k = F.col("o_orderkey")
    # every other order speaks of a second id, which is retired into the customer's own
    who = F.when(k % 2 == 0, key("c-", "o_custkey")).otherwise(key("old-", "o_custkey"))
    log = row(o, key("o-", "o_orderkey"), F.create_map(F.lit("action"), key("order ", "o_orderkey"), F.lit("status"), order_status(), F.lit("about"), who), k)
    log = log.unionByName(row(c, key("c-", "c_custkey"), F.create_map(F.lit("entity"), F.col("c_name"), F.lit("unit"), F.col("c_mktsegment")), F.col("c_custkey")))
    log = log.unionByName(row(c, key("old-", "c_custkey"), F.create_map(F.lit("entity"), F.col("c_name"), F.lit("same_as"), key("c-", "c_custkey")), F.col("c_custkey") + 10**9))
    return load(log).eval("action[status=open] -about-> entity[unit=BUILDING]")


# ---------------------------------------------------------------- assembly


def _merging(spark, d):
    """Customers whose number leaves 1 or 2 by 5 are retired into the one before them."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    nodes = node(c, id=key("c-", "c_custkey"), kind=F.lit("entity"), same_as=F.when((k % 5).isin(1, 2), F.concat(F.lit("c-"), (k - 1).cast("string"))), aliases=F.array(F.struct(F.col("c_name").alias("as"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("until"))))
    return nodes.unionByName(order_nodes(o, aliases=F.array().cast(nodes.schema["aliases"].dataType))), edge(o, key("o-", "o_orderkey"), "about", key("c-", "o_custkey"))


_SURVIVES = "{0} - case when {0} % 5 in (1, 2) then {0} % 5 else 0 end"


@query("select 'c-' || (" + _SURVIVES.format("o_custkey") + ") as dst, count(distinct o_orderkey) as n from orders group by 1")
def q_merged_edges(spark, d):
    nodes, edges = _merging(spark, d)
    return graph.merged(nodes, edges)[1].where("type = 'about'").groupBy("dst").agg(F.count("*").alias("n"))


@query("select 'c-' || c_custkey as id, 'c-' || (c_custkey - c_custkey % 5) as survivor, null as fault from customer where c_custkey % 5 in (1, 2)")
def q_retired(spark, d):
    return graph.retired(_merging(spark, d)[0])


@query("select 'c-' || c_custkey as ref, 'c-' || (c_custkey - c_custkey % 5) as id from customer where c_custkey % 5 in (1, 2)")
def q_resolved_retired(spark, d):
    """Retired ids denote their survivors."""
    nodes, _ = _merging(spark, d)
    c = table(spark, d, "customer").where("c_custkey % 5 in (1, 2)")
    gone = graph.retired(nodes)
    left = nodes.join(gone.where("fault is null").select("id"), "id", "left_anti")
    refs = c.select(key("c-", "c_custkey").alias("ref"), F.lit(None).cast("string").alias("at"))
    return graph.resolved(refs, left, gone, graph.aliases(left)).select("ref", "id")


@query(TRADE_SQL + ", e as (select src, dst from member_of union all select src, dst from about) select nid as id, count(*) as n from (select src as nid from e union all select dst from e) group by nid")
def q_incidence(spark, d):
    g = trade(spark, d)
    return graph.incidence(g.nodes, g.edges).groupBy(F.col("nid").alias("id")).agg(F.count("*").alias("n"))


@query(TRADE_SQL + """, e as (select src, dst, 'member_of' as t from member_of union all select src, dst, 'about' from about), z as (select chr(0) as z),
inc as (select nid, string_agg(t || z || src || z || dst || z || z || z || z, '' order by t || z || src || z || dst || z || z || z) as digests from (select src as nid, * from e union all select dst, * from e), z group by nid),
p as (select n.id, n.kind || z || coalesce(n.body, '') || z || coalesce(n.status, '') || z || coalesce(w.owner, '') || z || coalesce(n.day_at, '') || z || z || coalesce(n.day_at, '') || z || z || z || z || 'day' || z || z || z || z || coalesce(n.unit, '') || z
  || case when n.value is null then '' when n.value = floor(n.value) then n.value::bigint::varchar else n.value::varchar end || z || 'false|false' || z || z || z || coalesce(digests, '') as whole
  from nodes n left join inc on nid = n.id left join orders_n w on w.id = n.id, z)
select id, substr(sha256(whole), 1, 16) as sem_hash from p""")
def q_semantic_hashes(spark, d):
    g = trade(spark, d)
    nodes = g.nodes.withColumn("aliases", F.coalesce("aliases", F.array().cast(g.nodes.schema["aliases"].dataType)))
    return graph.with_hashes(nodes, graph.incidence(g.nodes, g.edges)).select("id", "sem_hash")


# ---------------------------------------------------------------- recorded answers


@query(ORDERS_SQL + " select 'c-' || c as id from o where value > 495000 union select id from o where value > 495000")
def q_pinned(spark, d):
    """The rows of two pinned answers with the nodes that either uses."""
    g = trade(spark, d)
    found = {"dear": pins.pin(g, "action[value>495000]"), "whose": pins.pin(g, "entity <-about- action[value>495000]")}
    return pins.facts_used(found, spark).select("id")


@query(ORDERS_SQL + """, w as (select *, case when k % 20 = 0 then 'done' else status end as s2 from o) select id from w where s2 = 'done' union select id from w where s2 = 'done' and value > 450000""")
def q_what_if(spark, d):
    """What would hold if every twentieth order were done."""
    g = trade(spark, d)
    few = table(spark, d, "orders").where("o_orderkey % 20 = 0")
    other = pins.what_if(g, order_nodes(few, status=F.lit("done")), edge(few, key("o-", "o_orderkey"), "about", key("c-", "o_custkey")))
    return other.eval("action[status=done] -about-> entity").union(other.eval("action[status=done] & action[value>450000]")).distinct()


@query("select * from (values ('as it was', 'fresh'), ('never', 'never-asked'), ('other text', 'query-changed'), ('other graph', 'results-changed'), ('other words', 'dialect-changed')) t(\"case\", state)")
def q_drift(spark, d):
    g = trade(spark, d)
    said = "entity <-about- action[value>480000]"
    one = table(spark, d, "orders").where("o_totalprice > 480000")
    other = pins.what_if(g, order_nodes(one, o_totalprice=F.lit(1.0), value=F.lit(1.0)), edge(one, key("o-", "o_orderkey"), "about", key("c-", "o_custkey")))
    was = pins.pin(g, said)
    cases = {
        "as it was": pins.drift(g, said, was, recorded_query=pins.query_hash(said.replace(" ", "  "))), "never": pins.drift(g, said, None), "other text": pins.drift(g, said, was, recorded_query=pins.query_hash("entity")),
        "other graph": pins.drift(other, said, was), "other words": pins.drift(g, said, was, dialect_hash="x"),
    }
    return constant(spark, [(k, s) for k, v in cases.items() for s in v], "`case` string, state string")


@query("""select * from (values ('q-1', 'a-1', 'plans', 'plans gained: e-1'), ('q-1', 'a-2', 'plans', 'plans gained: e-2'), ('q-1', 'a-1', 'plans', 'plans: 0 rows became 1'), ('q-1', 'a-2', 'plans', 'plans: 0 rows became 1')) t(question, option, name, statement)""")
def q_variants(spark, d):
    """An open question with two options, each of which one event waits for."""
    rows = [("q-1", "question", "open", None, ["a-1", "a-2"]), ("a-1", "claim", "proposed", None, None), ("a-2", "claim", "proposed", None, None), ("e-1", "event", "asserted", "a-1", None), ("e-2", "event", "asserted", "a-2", None)]
    base = constant(spark, rows, "id string, kind string, status string, `while` string, options array<string>")
    n = node(base, id=F.col("id"), kind=F.col("kind"), status=F.col("status"), body=F.col("id"), options=F.col("options"), aliases=F.array().cast("array<struct<as:string,from:string,until:string>>"), **{"while": F.col("while")})
    g = Graph(n, edge(base, F.lit("x"), "about", F.lit("y")).limit(0), now="2024-01-01", closed=True)
    return pins.variants(g, {"plans": "event @now"})


@query(EVIDENCE_SQL + " select distinct src as id from attests where dst in (select id from claims where under is not null) union select src from against where dst in (select id from claims where under is not null)")
def q_cited(spark, d):
    g = Graph(*evidence(spark, d))
    return pins.cited(g, g.eval("claim[underdetermined]"))


@query("""select * from (values ('claims', 'k-3', 'k-4', 'contradicts'), ('claims', 'k-6', 'k-7', 'contradicts')) t(name, src, dst, type)""")
def q_split_sets(spark, d):
    """A set that holds one end of a contradiction both ends of which count, or the target of a one-way one."""
    g = Graph(*evidence(spark, d))
    found = checks.split_sets(g, {"claims": "#k-3 | #k-7"})
    return found.select(F.lit("claims").alias("name"), F.col("subjects")[0].alias("src"), F.col("subjects")[1].alias("dst"), F.lit("contradicts").alias("type")).where(F.col("src").startswith("k-"))


# ---------------------------------------------------------------- checks


@query("select 'broad' as \"check\", 'warn' as severity, 'all' as subjects, 'holds ' || count(*) || ' of ' || count(*) as message from orders union all select 'broad', 'warn', 'most', 'holds ' || count(*) filter (where o_totalprice > 40000) || ' of ' || count(*) from orders having count(*) filter (where o_totalprice > 40000) * 100 >= count(*) * 75")
def q_check_broad(spark, d):
    return findings(checks.broad_sets(trade(spark, d), {"all": ("action", True), "most": ("action[value>40000]", False), "few": ("action[value>400000]", False)}))


@query("select 'empty' as \"check\", 'warn' as severity, 'none' as subjects, 'has no rows' as message")
def q_check_empty(spark, d):
    return findings(checks.empty_sets(trade(spark, d), {"none": "action[value<0]", "some": "action"}))


@query("select 'duplicate-id' as \"check\", 'error' as severity, 'o-' || l_orderkey as subjects, 'declared ' || count(*) || ' times' as message from lineitem group by l_orderkey having count(*) > 1")
def q_check_duplicate_ids(spark, d):
    return findings(checks.duplicate_ids(node(table(spark, d, "lineitem"), id=key("o-", "l_orderkey"), kind=F.lit("action"))))


@query("select 'repeated-edge' as \"check\", 'warn' as severity, 's-' || l_suppkey || ' p-' || l_partkey as subjects, 'serves is stated ' || count(*) || ' times' as message from lineitem group by l_suppkey, l_partkey having count(*) > 1")
def q_check_repeated_edges(spark, d):
    return findings(checks.repeated_edges(edge(table(spark, d, "lineitem"), key("s-", "l_suppkey"), "serves", key("p-", "l_partkey"))))


@query(EVIDENCE_SQL + " select 'ignored-verdict' as \"check\", 'warn' as severity, fact || ' ' || source as subjects, 'only a signed person takes an attestation away' as message from verdict where verdict = 'unsupported' and (by_who is null or machine)")
def q_check_ignored_verdicts(spark, d):
    return findings(checks.ignored_verdicts(verdicts(spark, d)))


@query(EVIDENCE_SQL + " select 'underdetermined' as \"check\", 'warn' as severity, id as subjects, case when k = 13 then 'is split: withdraw it' else 'is not one fact: split it' end as message from claims where under is not null and status <> 'withdrawn' union all select 'supersession', 'warn', 'k-13', 'is superseded but has no end' from claims where id = 'k-13' and vu is null")
def q_check_superseded(spark, d):
    nodes, edges = evidence(spark, d)
    more = constant(spark, [("k-14", "k-13"), ("k-15", "k-13"), ("k-16", "k-11")], "a string, b string")
    edges = edges.unionByName(edge(more, F.col("a"), "supersedes", F.col("b")))
    return findings(checks.underdetermined(nodes, edges).union(checks.open_supersession(nodes, edges)))


@query("select 'anchor' as \"check\", 'error' as severity, 'c-' || c_custkey || ' n-' || c_nationkey as subjects, 'an entity is about nothing' as message from customer union all select 'anchor', 'warn', 'e-' || o_orderkey || ' o-' || o_orderkey, 'an event is about an entity' from orders where o_orderkey % 3 = 0")
def q_check_anchors(spark, d):
    c, n, o = (table(spark, d, t) for t in ("customer", "nation", "orders"))
    third = o.where("o_orderkey % 3 = 0")
    nodes = _union([node(c, id=key("c-", "c_custkey"), kind=F.lit("entity")), node(n, id=key("n-", "n_nationkey"), kind=F.lit("entity")), order_nodes(o), node(o, id=key("e-", "o_orderkey"), kind=F.lit("event"))])
    edges = _union([edge(c, key("c-", "c_custkey"), "about", key("n-", "c_nationkey")), edge(third, key("e-", "o_orderkey"), "about", key("o-", "o_orderkey")), edge(o.where("o_orderkey % 3 <> 0"), key("e-", "o_orderkey"), "about", key("c-", "o_custkey"))])
    return findings(checks.anchor_layers(nodes, edges))


@query(TURNS_SQL + ", q as (select id, conv_id from t where turn = 0 and conv_id % 3 = 0) select 'open-question' as \"check\", 'warn' as severity, id as subjects, 'says not what it needs' as message from q where conv_id % 2 = 0 union all select 'open-question', 'warn', id, 'has neither owner nor subject' from q where conv_id % 5 <> 0")
def q_check_questions(spark, d):
    nodes, edges = turns(spark, d)
    conv = F.split("id", "-")[1].cast("int")
    nodes = nodes.withColumns({"needs": F.when(conv % 2 != 0, "evidence"), "owner": F.when(conv % 10 == 0, "me")})
    about = nodes.where((F.col("kind") == "question") & (conv % 10 == 5))
    return findings(checks.open_questions(nodes, edges.unionByName(edge(about, F.col("id"), "about", F.lit("e")))))


@query(EVIDENCE_SQL + " select 'inference' as \"check\", 'warn' as severity, id as subjects, 'has no premises' as message from sources where doc_id % 2 = 0 union all select 'inference', 'error', src || ' ' || dst, 'attests to its own premise' from attests where substr(src, 3)::bigint % 2 = 1")
def q_check_inferences(spark, d):
    """Odd documents rest on the claim that they may attest themselves."""
    nodes, edges = evidence(spark, d)
    number = F.substring("id", 3, 20).cast("long")
    premise = F.when((F.col("kind") == "source") & (number % 2 == 1), F.array(F.concat(F.lit("k-"), (number % 97).cast("string"))))
    return findings(checks.inference_grounds(nodes.withColumns({"form": F.when(F.col("kind") == "source", "inference"), "premises": premise}), edges))


@query("select 'branch' as \"check\", 'error' as severity, 'q-' || o_custkey || ' ' || string_agg('o-' || o_orderkey, ' ' order by 'o-' || o_orderkey) as subjects, 'several options are asserted' as message from orders where o_orderstatus = 'F' group by o_custkey having count(*) > 1 union all select 'branch', 'warn', 'q-' || o_custkey || ' o-' || o_orderkey, 'nothing is planned for the option' from orders where o_orderkey % 2 = 0")
def q_check_branches(spark, d):
    """A question for each customer whose orders are the options; plans wait for the odd ones."""
    o = table(spark, d, "orders")
    asks = o.groupBy("o_custkey").agg(F.collect_list(key("o-", "o_orderkey")).alias("opts"))
    nodes = _union([order_nodes(o, status=F.when(F.col("o_orderstatus") == "F", "asserted").otherwise("proposed")), node(asks, id=key("q-", "o_custkey"), kind=F.lit("question"), status=F.lit("open"), options=F.col("opts"))])
    return findings(checks.branches(nodes, edge(o.where("o_orderkey % 2 = 1"), F.lit("x"), "requires", F.lit("y"), **{"while": key("o-", "o_orderkey")})))


@query("select 'group' as \"check\", 'warn' as severity, 'g-' || c_custkey as subjects, 'has no rule' as message from customer where c_custkey % 4 = 0 union all select 'group', 'warn', 'g-' || c_custkey, 'has no members' from customer where c_custkey not in (select o_custkey from orders)")
def q_check_groups(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    nodes = node(c, id=key("g-", "c_custkey"), kind=F.lit("group"), group_expr=F.when(F.col("c_custkey") % 4 != 0, "any"))
    return findings(checks.groups(nodes, edge(o, key("o-", "o_orderkey"), "member_of", key("g-", "o_custkey"))))


@query("select 'high-water' as \"check\", 'warn' as severity, '' as subjects, 'more than half of the nodes are gone' as message union all select 'high-water', 'error', '', 'all nodes are gone'")
def q_check_high_water(spark, d):
    n = trade(spark, d).nodes
    return findings(checks.high_water(n, 10**9).union(checks.high_water(n, 5)).union(checks.high_water(n.limit(0), 5)))


@query("select 'boundary' as \"check\", 'warn' as severity, 'd-' || doc_id as subjects, 'its document is outside: ' || case doc_id % 4 when 1 then '/tmp/' || doc_id else 'x/../../' || doc_id end as message from documents where doc_id % 4 in (1, 2)")
def q_check_boundary(spark, d):
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, key("/data/a/", "doc_id")).when(k % 4 == 1, key("/tmp/", "doc_id")).when(k % 4 == 2, key("x/../../", "doc_id")).otherwise(key("x/", "doc_id"))
    return findings(checks.index_boundary(node(table(spark, d, "documents"), id=key("d-", "doc_id"), kind=F.lit("source"), doc=path), "/data/a"))


@query("select 'relation' as \"check\", 'warn' as severity, 'd-' || doc_id as subjects, case when doc_id % 10 = 1 then 'its document is a copy of p' || (doc_id - 1) else 'its document is a version of p' || (doc_id + 1) end as message from documents where doc_id % 10 in (1, 5)")
def q_check_relations(spark, d):
    """Every tenth document is copied by the next one, and the fifth of ten is an older version of the sixth."""
    docs = table(spark, d, "documents")
    k, p = F.col("doc_id"), lambda c: F.concat(F.lit("p"), c.cast("string"))
    ruled = docs.where("doc_id % 10 = 0").select(p(k).alias("a"), p(k + 1).alias("b"), F.lit("copy").alias("kind"), p(k).alias("supersedes")).union(docs.where("doc_id % 10 = 5").select(p(k), p(k + 1), F.lit("version"), p(k + 1)))
    ruled = ruled.union(docs.where("doc_id % 10 = 7").select(p(k), p(k + 1), F.lit("apart"), F.lit(None)))
    return findings(checks.document_relations(node(docs, id=key("d-", "doc_id"), kind=F.lit("source"), doc=p(k)), ruled))


@query(EVIDENCE_SQL + """, bad as (select id from claims where status = 'asserted' and id not in (select dst from attests)) select id, case when id in ('k-1', 'k-2', 'k-3', 'k-4', 'k-5') and false then 'x' else 'error' end as severity, false as accepted from bad""")
def q_levelled_and_triaged(spark, d):
    """A rule raises a warning to an error, which nobody can accept."""
    nodes, edges = evidence(spark, d)
    rows = checks.levelled(checks.unsourced(nodes, edges), {"unsourced": "error"})
    rows = checks.keyed(rows, nodes.select("id", F.lit("h").alias("sem_hash")))
    accepted = rows.select("key", F.lit("me").alias("by_who"), F.lit(False).alias("machine"))
    return checks.triaged(rows, accepted).select(F.col("subjects")[0].alias("id"), "severity", "accepted")


@query(EVIDENCE_SQL + ", bad as (select id, k from claims where status = 'asserted' and id not in (select dst from attests)) select id, substr(sha256('unsourced' || chr(10) || id || '@h' || k), 1, 16) as key, k % 2 = 0 as accepted from bad")
def q_finding_keys(spark, d):
    """A warning's key follows its subject's hash; half of them a person accepted, the others a machine."""
    nodes, edges = evidence(spark, d)
    rows = checks.keyed(checks.unsourced(nodes, edges), nodes.select("id", F.concat(F.lit("h"), F.substring("id", 3, 20)).alias("sem_hash")))
    odd = F.substring(F.col("subjects")[0], 3, 20).cast("long") % 2 == 1
    done = checks.triaged(rows, rows.select("key", F.lit("me").alias("by_who"), odd.alias("machine")))
    return done.select(F.col("subjects")[0].alias("id"), "key", "accepted")


# ---------------------------------------------------------------- duplicates, quotations, attestation, provenance


@query("with s as (" + SQL["q_near_dupes"] + "), b as (select a as id, b as other, score from s union all select b, a, score from s) select id, other, score from (select *, row_number() over (partition by id order by score desc, other) as r from b) where r = 1")
def q_best_matches(spark, d):
    from evigraph.catalog import q_near_dupes

    return dedupe.best_matches(q_near_dupes(spark, d))


@query("select '(a)' as part, 'd-' || doc_id as id, count(*) over (partition by source) as n from documents where source in (select source from documents group by source having count(*) > 1)")
def q_clusters(spark, d):
    """Sources on one document are one cluster."""
    nodes, edges = evidence(spark, d)
    none = constant(spark, [], "a string, b string")
    found = dedupe.clusters(nodes.where("kind = 'source'"), edges.limit(0), none)
    return found.select(F.lit("(a)").alias("part"), F.explode("ids").alias("id"), F.size("ids").cast("long").alias("n"))


@query(r"""select 'b-' || item_id as id, md5(regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g')) as fold, 2 as n from benchmark where length(text) between 60 and 400""")
def q_quoted_spans(spark, d):
    """Each item in straight and in curly quotes: two equal quotations."""
    b = table(spark, d, "benchmark").where("length(text) between 60 and 400")
    n = node(b, id=key("b-", "item_id"), kind=F.lit("claim"), body=F.concat(F.lit('He said "'), F.col("text"), F.lit('" and then “'), F.col("text"), F.lit("” again, \"shortly\".")))
    return quotes.quotes_of(n).groupBy("id", F.md5("fold").alias("fold")).agg(F.count("*").alias("n"))


@query(r"""with b as (select item_id, text from benchmark where length(text) between 60 and 380 and not contains(text, chr(10))) select 'b-' || item_id as id, case item_id % 3 when 0 then 'present' when 1 then 'unreadable' else 'absent' end as state, case when item_id % 3 = 0 then 2 end as page, case when item_id % 3 = 0 then 4 end as line from b""")
def q_checked_quotes(spark, d):
    """Quotations that stand on page 2 of their document, that its document lacks, or whose document has no text."""
    b = table(spark, d, "benchmark").where("length(text) between 60 and 380 and not contains(text, '\n')")
    k = F.col("item_id")
    facts = node(b, id=key("b-", "item_id"), kind=F.lit("claim"), body=F.concat(F.lit('"'), F.col("text"), F.lit('"')))
    sources = node(b, id=key("s-", "item_id"), kind=F.lit("source"), form=F.lit("document"), doc=key("doc", "item_id"))
    page = F.concat(F.lit("\n## Page 1\nfirst\n## Page 2\n").substr(F.lit(2), F.lit(100)), F.col("text"), F.lit("\nend"))
    texts = b.select(key("doc", "item_id").alias("path"), F.when(k % 3 == 0, page).when(k % 3 == 2, F.lit("nothing of the kind")).alias("text"))
    return quotes.checked(_union([facts, sources]), edge(b, key("s-", "item_id"), "attests", key("b-", "item_id")), texts).where(F.col("id").startswith("b-")).select("id", "state", "page", "line")


@query("select 'k-' || item_id as fact, case item_id % 4 when 0 then 'intact' when 1 then 'document-moved' when 2 then 'fact-moved' else 'unreadable' end as state from benchmark")
def q_excerpts(spark, d):
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    v = b.select(key("k-", "item_id").alias("fact"), F.lit("s").alias("source"), key("p", "item_id").alias("doc"), F.substring("text", 5, 60).alias("excerpt"), F.lit("h").alias("fact_hash"))
    facts = b.select(key("k-", "item_id").alias("id"), F.when(k % 4 == 2, "other").otherwise("h").alias("sem_hash"))
    return quotes.excerpt_states(v, facts, b.select(key("p", "item_id").alias("path"), F.when(k % 4 == 1, "something else").when(k % 4 != 3, F.col("text")).alias("text"))).select("fact", "state")


@query("select 'p' || doc_id as path, 40 as n, 0 as numbered from documents")
def q_unnumbered_lines(spark, d):
    """Forty numbered lines each: all numbers go."""
    docs = table(spark, d, "documents").select(key("p", "doc_id").alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit(" "), (k % 25 + 1).cast("string"), F.lit("  said the witness"))), "\n").alias("text"))
    lines = F.split("text", "\n")
    return quotes.without_line_numbers(docs).select("path", F.size(lines).cast("long").alias("n"), F.size(F.filter(lines, lambda x: x.rlike("[0-9]"))).cast("long").alias("numbered"))


@query(r"""with o as (select doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) as one from documents where text is not null) select doc_id, md5(case when length(one) <= 80 then one else one[:79] || '…' end) as short, length(one) as size from o""")
def q_excerpt(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(text.excerpt(F.col("text"), 80)).alias("short"), F.char_length(F.btrim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("size"))


@query("select 'AF # ' || p_partkey || '00000001' as name, case when length(p_partkey::varchar) > 0 then 'af' || p_partkey || '00000001' end as whole, p_partkey || '00000001' as bare from part")
def q_identifier_forms(spark, d):
    p = table(spark, d, "part").select(F.concat(key("AF # ", "p_partkey"), F.lit("00000001")).alias("name"))
    f = text.identifier_forms(F.col("name"))
    return p.select("name", f[0].alias("whole"), f[1].alias("bare"))


@query("select 'o-' || o_orderkey as id, case o_orderkey % 3 when 0 then 'order ' || o_orderkey || ' (o-' || o_orderkey || ')' when 1 then 'o-' || o_orderkey else 'any (o-' || o_orderkey || ')' end as label from orders")
def q_labels(spark, d):
    k = F.col("o_orderkey")
    n = order_nodes(table(spark, d, "orders"), body=F.when(k % 3 == 0, key("order ", "o_orderkey")), kind=F.when(k % 3 == 2, "group").otherwise("action"), group_expr=F.when(k % 3 == 2, "any"))
    return n.select("id", text.label(F.col("id"), F.col("kind"), F.col("body"), F.col("title"), F.col("group_expr")).alias("label"))


@query("select 'p' || item_id as path, octet_length(encode(text))::bigint as size, sha256(text) as hash from benchmark")
def q_fingerprints(spark, d):
    b = table(spark, d, "benchmark")
    return provenance.fingerprints(b.select(key("p", "item_id").alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content")))


@query("select 'p' || doc_id as id, case doc_id % 5 when 0 then 'base/a/' || doc_id when 1 then 'base/' || doc_id when 2 then null when 3 then null else 'base/b/' || doc_id end as path from documents")
def q_document_paths(spark, d):
    k = F.col("doc_id")
    doc = F.when(k % 5 == 0, key("a/", "doc_id")).when(k % 5 == 1, key("a/../", "doc_id")).when(k % 5 == 2, key("../", "doc_id")).when(k % 5 == 3, key("/", "doc_id")).otherwise(key("./b//", "doc_id"))
    return table(spark, d, "documents").select(key("p", "doc_id").alias("id"), provenance.resolved_path(doc, F.lit("base")).alias("path"))


@query(SQL["q_source_status"].rsplit(" select id, path, state from status", 1)[0] + ", take as (select distinct path from status where state in ('unrecorded', 'changed')) select path, hash, '2024-01-01' as \"at\" from new where path in (select path from take) union all select path, hash, '2020-01-01' from old where path not in (select path from take)")
def q_locked(spark, d):
    from evigraph.catalog import _files

    sources, old, new = _files(spark, d)
    return provenance.locked(old.withColumn("at", F.lit("2020-01-01")), provenance.source_status(sources, old, new), new, "2024-01-01").select("path", "hash", "at")


@query(EVIDENCE_SQL + ", c as (select dst, count(*) as cites from attests group by dst), w as (" + SQL["q_pending"].split(EVIDENCE_SQL, 1)[1] + "), tens as (" + "select * from (" + _TENSE + ")) select case when tension = 'disputed' then 0 when tension = 'impeached' then 1 when substr(fact, 3)::int % 2 = 0 then 2 when cites = 1 then 3 else 4 end as band, fact, source, cites from w left join tens on tens.id = fact left join c on c.dst = fact")
def q_ranked_queue(spark, d):
    """What waits for a verdict by its band; facts with even numbers are pinned."""
    from evigraph.sources.dialect import LEGAL

    nodes, edges = evidence(spark, d)
    pinned = nodes.where("kind = 'claim' and cast(substr(id, 3) as int) % 2 = 0").select("id")
    return attest.ranked(attest.pending(nodes, edges, verdicts(spark, d)), nodes, edges, derive.tension(nodes, edges, LEGAL.ranks(spark)), pinned)


@query(EVIDENCE_SQL + ", a as (select dst, src, src in (select 'd-' || doc_id from documents where doc_id % 5 <> 0) and substr(dst, 3)::int % 2 = 0 as gone from attests) select dst as fact from a join claims on claims.id = dst where status <> 'withdrawn' group by dst having bool_and(gone)")
def q_miscited(spark, d):
    """A person takes back all citations of even claims, but for every fifth document's."""
    nodes, edges = evidence(spark, d)
    docs = table(spark, d, "documents").where("doc_id % 5 <> 0 and (doc_id % 97) % 2 = 0")
    said = docs.select(F.concat(F.lit("k-"), (F.col("doc_id") % 97).cast("string")).alias("fact"), key("d-", "doc_id").alias("source"), F.lit("unsupported").alias("verdict"), F.lit("me").alias("by_who"), F.lit(False).alias("machine"))
    return attest.miscited(nodes, edges, said, nodes.where("kind = 'claim'").select("id"))


@query(EVIDENCE_SQL + " select source, stands from (select source, not coalesce(verdict = 'unsupported' and by_who is not null and not machine, false) as stands from verdict)")
def q_standing_verdicts(spark, d):
    return verdicts(spark, d).select("source", attest.stands(F.col("verdict"), F.col("by_who"), F.col("machine")).alias("stands"))


@query("select 'q-' || doc_id as id, 'af' || (10000000 + doc_id) as identifier, 'p' || doc_id as path from documents where doc_id % 2 = 0 union all select 'q-' || doc_id, (10000000 + doc_id)::varchar, 'p' || doc_id from documents where doc_id % 2 = 0")
def q_already_held(spark, d):
    docs = table(spark, d, "documents")
    number = (F.col("doc_id") + 10**7).cast("string")
    asks = node(docs, id=key("q-", "doc_id"), kind=F.lit("question"), status=F.lit("open"), body=F.concat(F.lit("Where is AF "), number, F.lit("?")))
    texts = docs.where("doc_id % 2 = 0").select(key("p", "doc_id").alias("path"), F.concat(F.lit("AF"), number).alias("text"))
    return have.already_held(asks, texts)


@query("select * from (values ('alias', 'd-1', 'p-1'), ('source', 'd-2', 'p-2'), ('path', 'x/PL 22-1234.txt', 'x/PL 22-1234.txt'), ('text', 't', 't')) t(tier, key, doc)")
def q_have(spark, d):
    """One registry number as an alias, in a source, in a path and in a text."""
    rows = constant(spark, [("d-1", "a report", "PL 22-1234", "p-1"), ("d-2", "Notice of PL22-1234", None, "p-2"), ("d-3", "another report", None, "p-3")], "id string, body string, name string, doc string")
    alias = F.when(F.col("name").isNotNull(), F.array(F.struct(F.col("name").alias("as"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("until")))).otherwise(F.array().cast("array<struct<as:string,from:string,until:string>>"))
    nodes = node(rows, id=F.col("id"), kind=F.lit("source"), form=F.lit("document"), body=F.col("body"), doc=F.col("doc"), aliases=alias)
    texts = constant(spark, [("x/PL 22-1234.txt", "empty"), ("t", "as pl 22 - 1234 says"), ("u", "nothing")], "path string, text string")
    return have.have(nodes, texts, "PL 22-1234").select("tier", "key", "doc")


@query("select 'k-' || o_orderkey as id, least('p-' || o_orderkey, 'p-' || (o_orderkey + 1)) || ' ' || greatest('p-' || o_orderkey, 'p-' || (o_orderkey + 1)) as premises from orders")
def q_known_premises(spark, d):
    o = table(spark, d, "orders")
    one = edge(o, key("p-", "o_orderkey"), "supports", key("k-", "o_orderkey"))
    two = edge(o, F.concat(F.lit("p-"), (F.col("o_orderkey") + 1).cast("string")), "causes", key("k-", "o_orderkey"))
    got = derive.known_premises(one.unionByName(two).unionByName(edge(o, F.lit("z"), "about", key("k-", "o_orderkey"))))
    return got.select("id", F.array_join("premises", " ").alias("premises"))
