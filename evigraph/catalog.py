"""The registered queries over the driver's tables, each with the SQL it must agree with.

The tables are projected onto the model: regions, nations, customers and suppliers are entities that are members of each other; orders
are actions about customers; events form an assertion log; conversation turns require the turn before; documents are sources that
attest or contradict claims as their labels say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import compare, text
from evigraph.model import EDGE, NODE
from evigraph.operators import attest, checks, closure, dedupe, derive, fold, graph, pins, provenance, quotes
from evigraph.plans.compile import Graph, closed
from evigraph.sources.shared import written

NOW = "1998-06-15"
BUCKETS = 97


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _typed(df: DataFrame, schema: str, **cols) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    text_of = lambda v: F.lit(v) if not isinstance(v, Column) else v
    return df.select(*(text_of(cols[f.name]).cast(f.dataType).alias(f.name) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def node(df: DataFrame, **cols) -> DataFrame:
    """Nodes of a table, with NULL for what isn't said."""
    return _typed(df, NODE, **{"ordered": F.lit(False), "exhaustive": F.lit(False), "recorded": F.lit(False), "precision": F.lit("day"), "pos": F.lit(0), **cols})


def edge(df: DataFrame, src, kind: str, dst, **cols) -> DataFrame:
    """Edges of a table."""
    return _typed(df, EDGE, src=src, dst=dst, type=F.lit(kind), **{"one_way": F.lit(False), "pos": F.lit(0), **cols})


def key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def order_status() -> Column:
    return F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("proposed")


def order_day() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def order_nodes(o: DataFrame, **cols) -> DataFrame:
    return node(o, **{"id": key("o-", "o_orderkey"), "kind": F.lit("action"), "body": key("order ", "o_orderkey"), "status": order_status(), "owner": key("c-", "o_custkey"), "at": order_day(), "valid_from": order_day(), "value": F.col("o_totalprice"), "unit": F.col("o_orderpriority"), **cols})


#: The trade graph's tables of each application and folder, written once as an index is loaded once.
_trade: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def trade(spark: SparkSession, d: str, now: str = NOW) -> Graph:
    """Regions, nations, customers, suppliers and orders."""
    key_of = (spark.sparkContext.applicationId, d)
    if key_of not in _trade:
        nodes, edges = _trade_rows(spark, d)
        nodes = written(nodes, "trade", by="kind")
        _trade[key_of] = nodes, written(closed(nodes, edges).select(*edges.columns), "trade", by="type")
    nodes, edges = _trade[key_of]
    g = Graph(nodes, edges, now=now, named={"open": "action[status=open]"}, closed=True)
    # the projection states no while and no expression
    g._kept.update({"gated": False, "no at_expr": True, "no value_expr": True})
    return g


def _trade_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, n, c, s, o = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    nodes = [
        node(r, id=key("r-", "r_regionkey"), kind=F.lit("entity"), body=F.col("r_name")),
        node(n, id=key("n-", "n_nationkey"), kind=F.lit("entity"), body=F.col("n_name")),
        node(c, id=key("c-", "c_custkey"), kind=F.lit("entity"), body=F.col("c_name"), value=F.col("c_acctbal"), unit=F.col("c_mktsegment")),
        node(s, id=key("s-", "s_suppkey"), kind=F.lit("entity"), body=F.col("s_name"), value=F.col("s_acctbal")),
        order_nodes(o),
    ]
    edges = [
        edge(n, key("n-", "n_nationkey"), "member_of", key("r-", "n_regionkey")),
        edge(c, key("c-", "c_custkey"), "member_of", key("n-", "c_nationkey")),
        edge(s, key("s-", "s_suppkey"), "member_of", key("n-", "s_nationkey")),
        edge(o, key("o-", "o_orderkey"), "about", key("c-", "o_custkey")),
    ]
    return _union(nodes), _union(edges)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same tables as nodes and edges, for the SQL side.
TRADE_SQL = """
with orders_n as (select 'o-' || o_orderkey as id, 'action' as kind, 'order ' || o_orderkey as body, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'proposed' end as status,
    strftime(o_orderdate, '%Y-%m-%d') as day_at, o_totalprice as value, o_orderpriority as unit, 'c-' || o_custkey as owner from orders),
entities as (select 'r-' || r_regionkey as id, r_name as body, null::double as value, null as unit from region union all select 'n-' || n_nationkey, n_name, null, null from nation
    union all select 'c-' || c_custkey, c_name, c_acctbal, c_mktsegment from customer union all select 's-' || s_suppkey, s_name, s_acctbal, null from supplier),
nodes as (select id, kind, body, status, day_at, value, unit from orders_n union all select id, 'entity', body, null, null, value, unit from entities),
member_of as (select 'n-' || n_nationkey as src, 'r-' || n_regionkey as dst from nation union all select 'c-' || c_custkey, 'n-' || c_nationkey from customer union all select 's-' || s_suppkey, 'n-' || s_nationkey from supplier),
about as (select id as src, owner as dst from orders_n)
"""

#: DSL queries over the trade graph with the condition or statement that SQL uses after TRADE_SQL.
DSL = {
    "q_kind_filter": ("entity", "select id from nodes where kind = 'entity'"),
    "q_kind_alternation": ('(entity|action) ~ "R#00000001"', "select id from nodes where contains(lower(body), 'r#00000001')"),
    "q_pred_eq": ("action[status=open]", "select id from nodes where status = 'open'"),
    "q_pred_ne": ("action[status!=open]", "select id from nodes where kind = 'action' and status <> 'open'"),
    "q_pred_in": ("action[status in (open,proposed)]", "select id from nodes where status in ('open', 'proposed')"),
    "q_pred_range": ("action[value>=250000,at<1997-03]", "select id from nodes where kind = 'action' and value >= 250000 and day_at < '1997-03'"),
    "q_pred_has": ("entity[unit]", "select id from nodes where kind = 'entity' and unit is not null"),
    "q_text_contains": ('entity ~ "nation_1"', "select id from nodes where kind = 'entity' and contains(lower(body), 'nation_1')"),
    "q_now_valid": ("action[status=open] @now", f"select id from nodes where status = 'open' and day_at <= '{NOW}'"),
    "q_as_of": ("action[status=done] @1996-02-29", "select id from nodes where status = 'done' and day_at <= '1996-02-29'"),
    "q_hop_forward": ("action -about-> entity[unit=BUILDING]", "select src as id from about join nodes n on n.id = dst where unit = 'BUILDING'"),
    "q_hop_inverse": ("entity[unit=BUILDING] <-about- action[status=open]", "select id from nodes where unit = 'BUILDING' and id in (select dst from about join nodes n on n.id = src where n.status = 'open')"),
    "q_hop_undirected": ("entity -member_of- #n-3", "select src as id from member_of where dst = 'n-3' union select dst from member_of where src = 'n-3'"),
    "q_multi_hop": ("action[status=open] -about-> entity -member_of-> entity -member_of-> #r-1", "select a.src as id from about a join member_of m on m.src = a.dst join member_of k on k.src = m.dst join nodes n on n.id = a.src where k.dst = 'r-1' and n.status = 'open'"),
    "q_closure": ("entity -member_of*-> #r-1", "select src as id from member_of where dst = 'r-1' union select m.src from member_of m join member_of k on k.src = m.dst where k.dst = 'r-1'"),
    "q_union": ("action[status=open] | entity[unit=BUILDING] | action[value>400000]", "select id from nodes where status = 'open' or unit = 'BUILDING' or (kind = 'action' and value > 400000)"),
    "q_intersect": ("action[status=open] & action[value>200000]", "select id from nodes where status = 'open' and value > 200000"),
    "q_complement": ("!(action[status=open] | entity)", "select id from nodes where kind = 'action' and status <> 'open'"),
    "q_scoped": ("(action[status=open] | action[status=done]) @1996-06-30", "select id from nodes where status in ('open', 'done') and day_at <= '1996-06-30'"),
    "q_named_reference": ("@open & action[value<100000]", "select id from nodes where status = 'open' and value < 100000"),
}


def _dsl(dsl: str):
    return lambda spark, d: trade(spark, d).eval(dsl)


def q_sort_topk(spark, d):
    g = trade(spark, d)
    rows = g.run("action sort value desc, id").limit(50)
    return fold.numbered(rows.join(g.nodes.select("id", "value"), "id").select("id", "value"), F.col("value").desc(), "id").select("id", F.col("ord").cast("long").alias("ord"))


def q_sort_nulls_last(spark, d):
    g = trade(spark, d)
    rows = g.run("entity sort unit desc, id").limit(40)
    return fold.numbered(rows.join(g.nodes.select("id", "unit"), "id"), *compare.sort_keys(F.col("unit"), True), "id").select("id", F.col("ord").cast("long").alias("ord"))


def _groups(spark, d):
    o = table(spark, d, "orders")
    rules = F.element_at(F.array(*map(F.lit, ("all", "any", "none", ">= 2", "< 3", "== 1", "sum(value)"))), (F.col("o_custkey") % 7 + 1).cast("int"))
    cust = o.select("o_custkey").distinct()
    nodes = order_nodes(o, status=F.when(order_status() == "open", "asserted").otherwise(order_status())).unionByName(node(cust, id=key("g-", "o_custkey"), kind=F.lit("group"), group_expr=rules))
    return nodes, edge(o, key("o-", "o_orderkey"), "member_of", key("g-", "o_custkey"))


def q_group_state(spark, d):
    return derive.group_state(*_groups(spark, d)).select("id", "total", "satisfied", F.size("blocking").cast("long").alias("blocking"), "ok")


def q_group_sum(spark, d):
    nodes, edges = _groups(spark, d)
    return derive.values(nodes, edges).where(F.col("id").startswith("g-")).select("id", F.round("value", 2).alias("value"))


def event_log(spark, d) -> DataFrame:
    """Events as assertions about users: signups and views assert, errors withdraw, purchases retire."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "withdraw").when(F.col("event_type") == "purchase", "retire").otherwise("assert")
    fields = F.create_map(F.lit("claim"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    return e.select(
        op.alias("op"), key("u-", "user_id").alias("id"), F.when(op == "assert", fields).alias("fields"), F.when(op == "withdraw", key("error ", "event_id")).alias("reason"), F.when(op == "retire", F.lit("u-buyer")).alias("into_id"),
        F.lit(None).cast("string").alias("note"), F.lit("driver").alias("by_who"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_id").cast("long").alias("pos"),
    )


def _folded(f: DataFrame) -> DataFrame:
    get = lambda k: F.element_at("fields", F.lit(k)).alias(k)
    return f.select("id", get("claim"), get("status"), get("reason"), get("same_as"), F.col("pos.pos").alias("first_pos"))


def q_fold(spark, d):
    return _folded(fold.fold(event_log(spark, d)))


def q_stream_refold(spark, d):
    from evigraph.sources.shared import shared_folder
    from evigraph.streaming.refold import log_stream, refold

    where = shared_folder(spark, "stream")
    event_log(spark, d).repartition(4).write.parquet(f"{where}/in")
    refold(log_stream(spark, f"{where}/in", 2), f"{where}/log", f"{where}/state", f"{where}/checkpoint").awaitTermination()
    return _folded(spark.read.parquet(f"{where}/state"))


def q_latest_record(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").alias("last_value"))
    return fold.latest(e, "user_id", "event_type", order="event_id").select("user_id", "event_type", "last_value", "event_id")


def q_derived_date(spark, d):
    o = table(spark, d, "orders")
    moved = node(o, id=key("d-", "o_orderkey"), kind=F.lit("event"), at_expr=F.concat(F.lit("= "), key("o-", "o_orderkey"), F.lit(".at + "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("mo - 10d + 1y")))
    again = node(o, id=key("f-", "o_orderkey"), kind=F.lit("event"), at_expr=F.concat(F.lit("= "), key("d-", "o_orderkey"), F.lit(".at + 180d")))
    got = derive.dates(_union([order_nodes(o), moved, again]))
    return got.where(F.col("id").startswith("d-") | F.col("id").startswith("f-"))


def q_derived_value(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rest = node(o, id=key("v-", "o_orderkey"), kind=F.lit("claim"), value_expr=F.concat(F.lit("= "), key("o-", "o_orderkey"), F.lit(".value - "), key("c-", "o_custkey"), F.lit(".value + 3")))
    cust = node(c, id=key("c-", "c_custkey"), kind=F.lit("entity"), value=F.col("c_acctbal"))
    empty = edge(o, F.lit("x"), "about", F.lit("y")).limit(0)
    return derive.values(_union([order_nodes(o), cust, rest]), empty).where(F.col("id").startswith("v-")).select("id", F.round("value", 2).alias("value"))


def q_alias_asof(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").where("event_type = 'signup'").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    names = e.select(key("user ", "user_id").alias("name"), key("e-", "event_id").alias("id"), F.col("t").alias("from"), F.lead("t").over(w).alias("until"))
    refs = table(spark, d, "events").where("event_type = 'error'").select(key("user ", "user_id").alias("ref"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    known = e.select(key("e-", "event_id").alias("id"))
    gone = spark.createDataFrame([], "id string, survivor string, fault string")
    return graph.resolved(refs, known, gone, names).select("ref", "at", "id", F.col("n").cast("long").alias("n"))


def evidence(spark, d):
    """Documents as sources; claims ``k-`` by doc_id; a good label attests, a bad one contradicts; neighbours contradict each other."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    classes = ("record", "admission", "document", "observation", "statement", "interested", "inference", "authority")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 8
    speaker = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p-"), (F.col("doc_id") % 5).cast("string")))
    sources = node(docs, id=key("d-", "doc_id"), kind=F.lit("source"), form=F.lit("document"), speaker=speaker, **{"class": F.element_at(F.array(*map(F.lit, classes)), number + 1)}, doc=F.col("source"))
    ids = spark.range(BUCKETS).select(F.col("id").alias("k"))
    claims = node(ids, id=key("k-", "k"), kind=F.lit("claim"), body=key("claim ", "k"), status=F.when(F.col("k") % 11 == 0, "withdrawn").otherwise("asserted"), underdetermined=F.when(F.col("k") % 13 == 0, "two facts"), valid_from=F.when(F.col("k") % 4 == 0, "2021-01-01"), valid_until=F.when(F.col("k") % 4 == 1, "2021-01-01"))
    claim = F.concat(F.lit("k-"), (F.col("doc_id") % BUCKETS).cast("string"))
    edges = _union([
        edge(labels.where("quality = 1"), key("d-", "doc_id"), "attests", claim), edge(labels.where("quality = 0 and toxic = 1"), key("d-", "doc_id"), "contradicts", claim),
        edge(ids.where("k % 3 = 0"), key("k-", "k"), "contradicts", F.concat(F.lit("k-"), ((F.col("k") + 1) % BUCKETS).cast("string")), one_way=F.col("k") % 2 == 0),
    ])
    return _union([sources, claims]), edges


def q_tension(spark, d):
    nodes, edges = evidence(spark, d)
    from evigraph.sources.dialect import LEGAL

    t = derive.tension(nodes, edges, LEGAL.ranks(spark))
    return t.select("id", "tension", "n_for", "n_against", F.size("beaten_by").cast("long").alias("n_beaten"))


def verdicts(spark, d) -> DataFrame:
    """Labels as verdicts about what documents attest: quality 0 unsupported, else confirmed; even ids are signed by people."""
    return table(spark, d, "labels").select(
        F.concat(F.lit("k-"), (F.col("doc_id") % BUCKETS).cast("string")).alias("fact"), key("d-", "doc_id").alias("source"), F.when(F.col("toxic") == 1, "unsupported").otherwise("confirmed").alias("verdict"),
        F.when(F.col("doc_id") % 4 != 1, "reader").alias("by_who"), (F.col("doc_id") % 2 == 1).alias("machine"), F.lit("2024-01-01").alias("at"), F.col("doc_id").alias("pos"),
    )


def q_pending(spark, d):
    nodes, edges = evidence(spark, d)
    return attest.pending(nodes, edges, verdicts(spark, d))


def q_verdict_report(spark, d):
    return attest.report(verdicts(spark, d)).select("verdict", "n", "last_at")


def q_check_unsourced(spark, d):
    nodes, edges = evidence(spark, d)
    return checks.unsourced(nodes, edges, verdicts(spark, d)).select(F.element_at("subjects", 1).alias("id"), "check", "severity")


def q_check_source_hygiene(spark, d):
    nodes, edges = evidence(spark, d)
    return checks.source_hygiene(nodes, edges, ("admission", "interested")).groupBy("check", "severity", "message").agg(F.count("*").alias("n"))


def q_check_dangling(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 10 <> 3")
    nodes = order_nodes(o).unionByName(node(c, id=key("c-", "c_custkey"), kind=F.lit("entity")))
    found = checks.dangling(nodes, edge(o, key("o-", "o_orderkey"), "about", key("c-", "o_custkey")))
    return found.groupBy(F.element_at("subjects", 2).alias("ref"), "message").agg(F.count("*").alias("n"))


def q_check_same_file(spark, d):
    nodes, _ = evidence(spark, d)
    return dedupe.same_file(nodes).select("doc", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"))


def turns(spark, d):
    """Conversation turns: each requires the one before; some first turns are open questions."""
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    tid = lambda turn: F.concat(F.lit("t-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    first = (F.col("turn") == 0) & (F.col("conv_id") % 3 == 0)
    nodes = node(t, id=tid(F.col("turn")), kind=F.when(first, "question").otherwise("event"), status=F.when(first, "open").otherwise("asserted"))
    return nodes, edge(t.where("turn > 0"), tid(F.col("turn")), "requires", tid(F.col("turn") - 1))


def q_taint(spark, d):
    return derive.taint(*turns(spark, d))


def q_closure_chain(spark, d):
    nodes, edges = turns(spark, d)
    return Graph(nodes, edges).eval("event -requires*-> question[status=open]")


def q_components(spark, d):
    _, edges = turns(spark, d)
    return closure.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def q_drifted_reach(spark, d):
    nodes, edges = evidence(spark, d)
    return derive.drifted_reach(edges, nodes.where("kind = 'source'").select(F.col("id").alias("start")))


def q_content_ids(spark, d):
    g = trade(spark, d)
    cid = F.substring(F.sha2(F.concat("kind", F.lit("\0"), text.normalized(F.col("body"))), 256), 1, 16)
    return g.nodes.select("id", cid.alias("cid"))


def q_edge_ids(spark, d):
    return trade(spark, d).edges.select("src", "dst", graph.edge_cid().alias("cid"))


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    h = lambda c: F.substring(F.sha2(c, 256), 1, 16).alias("sem_hash")
    before = o.where("o_orderkey % 10 <> 1").select(key("o-", "o_orderkey").alias("id"), h(F.concat_ws("|", "o_orderstatus", "o_orderpriority")))
    after = o.where("o_orderkey % 10 <> 2").select(key("o-", "o_orderkey").alias("id"), h(F.concat_ws("|", F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")), "o_orderpriority")))
    return before, after


def q_diff(spark, d):
    return pins.difference_table(*_snapshots(spark, d))


def q_profile(spark, d):
    return graph.profile(*evidence(spark, d))


def q_set_proportion(spark, d):
    g = trade(spark, d)
    n = g.eval("action[value>100000]").agg(F.count("*").alias("n"))
    return n.join(g.nodes.where("kind = 'action'").agg(F.count("*").alias("total"))).select("n", "total", F.expr("n * 100 div total").alias("percent"))


def doc_nodes(spark, d) -> DataFrame:
    return node(table(spark, d, "documents"), id=key("d-", "doc_id"), kind=F.lit("source"), body=F.col("text"))


def q_exact_dupes(spark, d):
    return dedupe.exact(doc_nodes(spark, d)).select(F.element_at("ids", 1).alias("first_id"), F.size("ids").cast("long").alias("n"))


def _near_dupes(docs: DataFrame) -> DataFrame:
    nodes = node(docs, id=key("d-", "doc_id"), kind=F.lit("claim"), body=F.col("text"))
    return dedupe.near(nodes, edge(nodes, F.lit("x"), "about", F.lit("y")).limit(0)).select("a", "b", F.round("score", 6).alias("score"))


def q_near_dupes(spark, d):
    return _near_dupes(table(spark, d, "documents"))


def q_rare_tokens(spark, d):
    n = node(table(spark, d, "benchmark"), id=key("b-", "item_id"), kind=F.lit("claim"), body=F.col("text"))
    return dedupe.rare_tokens(n).select("id", F.col("size").cast("long").alias("size"), "token")


def q_quote_homes(spark, d):
    q = table(spark, d, "benchmark").select(text.folded(F.col("text")).alias("fold"))
    docs = table(spark, d, "documents").select(key("d-", "doc_id").alias("path"), "text")
    return quotes.homes(q, docs).select(F.md5("fold").alias("quote"), "path")


def q_identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("identifier"))


def q_content_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(text.content_terms(F.col("text"))).alias("term"))


def q_fold_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(text.folded(F.col("text"))).alias("folded"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def _files(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 9 <> 0").select(key("a/", "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    moved = F.when(F.col("doc_id") % 7 == 0, key("b/", "doc_id")).otherwise(key("a/", "doc_id"))
    new = docs.where("doc_id % 8 <> 0").select(moved.alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"), F.octet_length(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).cast("long").alias("size"))
    sources = docs.select(key("d-", "doc_id").alias("id"), F.when(F.col("doc_id") % 31 != 0, key("a/", "doc_id")).alias("path"))
    return sources, old, new


def q_source_status(spark, d):
    return provenance.source_status(*_files(spark, d))


def q_relocate(spark, d):
    sources, old, new = _files(spark, d)
    return provenance.relocated(provenance.source_status(sources, old, new), old, new).select("id", "old", "new", "candidates")


def q_backlog(spark, d):
    nodes, edges = evidence(spark, d)
    docs = table(spark, d, "documents").select(F.concat(F.lit("src"), (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") + 3).cast("string")).alias("path")).distinct()
    return provenance.backlog(docs, nodes, edges, docs.select("path", F.lit(True).alias("readable"))).select("path", "state", "facts")


def _alias_conflicts(o: DataFrame) -> DataFrame:
    names = o.select(key("name ", "o_custkey").alias("name"), key("o-", "o_orderkey").alias("id"), order_day().alias("from"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 200), "yyyy-MM-dd").alias("until"))
    return graph.alias_conflicts(names).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("overlap").cast("long")).alias("overlaps"))


def q_alias_conflicts(spark, d):
    return _alias_conflicts(table(spark, d, "orders"))


def q_edge_dedupe(spark, d):
    li = table(spark, d, "lineitem")
    e = edge(li, key("o-", "l_orderkey"), "about", key("p-", "l_partkey"), pos=F.col("l_linenumber"))
    return graph.first_declared(e, *graph.EDGE_KEY).groupBy("src").agg(F.count("*").alias("n"))


def q_satisfied_while(spark, d):
    """Orders hold only while their customer's group does."""
    nodes, edges = _groups(spark, d)
    gated = nodes.withColumn("while", F.when((F.col("kind") == "action") & (F.substring("id", -1, 1) == "7"), F.concat(F.lit("g-"), F.substring("owner", 3, 20))).otherwise(F.col("while")))
    # members that wait for their own group stand on a cycle, which is false for them and decides the group anew
    return derive.satisfied(gated, edges).where("ok").groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


def q_near_miss(spark, d):
    from evigraph.functions.sound import near_miss

    b = table(spark, d, "benchmark").select("item_id", "text")
    changed = b.select("item_id", F.regexp_replace("text", r"^(\S+\s+\S+)\s+\S+", "$1 replaced").alias("quote"), "text")
    return changed.select("item_id", near_miss("quote", "text").alias("m")).select("item_id", "m.passage", F.round("m.ratio", 6).alias("ratio"))


def q_name_keys(spark, d):
    from evigraph.functions.sound import name_keys

    return table(spark, d, "part").select("p_partkey", F.array_join(name_keys("p_name"), " ").alias("keys"))


PYTHON = {f.__name__: f for f in (
    q_sort_topk, q_sort_nulls_last, q_group_state, q_group_sum, q_fold, q_stream_refold, q_latest_record, q_derived_date, q_derived_value, q_alias_asof, q_tension, q_pending, q_verdict_report, q_check_unsourced,
    q_check_source_hygiene, q_check_dangling, q_check_same_file, q_taint, q_closure_chain, q_components, q_drifted_reach, q_content_ids, q_edge_ids, q_diff, q_profile, q_set_proportion, q_exact_dupes,
    q_near_dupes, q_rare_tokens, q_quote_homes, q_identifiers, q_content_terms, q_fold_text, q_source_status, q_relocate, q_backlog, q_alias_conflicts, q_edge_dedupe, q_satisfied_while, q_near_miss, q_name_keys,
)}

QUERIES = {**{name: _dsl(dsl) for name, (dsl, _) in DSL.items()}, **PYTHON}
