"""Assembly of a graph: duplicate ids, merges of retired nodes, edge dedupe, incidence, hashes and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.sound import shortest_number
from evigraph.functions.text import normalized
from evigraph.sources.shared import unsized, written

EDGE_KEY = ["src", "dst", "type", "valid_from", "valid_until", "while"]


def first_declared(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of each key with the least ``pos``; NULL keys compare as equal. A partial aggregate, not a window."""
    rest = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in keys))
    cols = [F.col(f"`{k}`") for k in keys]
    return rows.groupBy(*cols).agg(F.min_by(rest, "pos").alias("first")).select(*cols, "first.*").select(*(F.col(f"`{c}`") for c in rows.columns))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return rows.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count("*").alias("times")).where("times > 1")


def retired(nodes: DataFrame) -> DataFrame:
    """(id, survivor, fault) of nodes with same_as: chains are followed by doubling steps; cycles, unknown ends and other kinds are faults."""
    links = written(nodes.where("same_as is not null").select("id", F.col("same_as").alias("to")), "retired")
    known = unsized(nodes.select(F.col("id").alias("to"), F.col("kind").alias("to_kind")))
    while True:
        hop = unsized(links.select(F.col("id").alias("to"), F.col("to").alias("next")))
        new = written(links.join(hop, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "retired")
        moved = new.join(unsized(links), ["id", "to"], "left_anti").isEmpty()
        links = new
        if moved:
            break
        # a cycle never settles; what points at itself or at a retired id after log2(n) doublings is one
        if links.where("id = to").limit(1).count():
            break
    ends = links.join(unsized(links.select(F.col("id").alias("to"), F.lit(True).alias("still"))), "to", "left").join(known, "to", "left").join(unsized(nodes.select("id", "kind")), "id")
    fault = F.when(F.coalesce("still", F.lit(False)), "cycle").when(F.col("to_kind").isNull(), "unknown").when(F.col("to_kind") != F.col("kind"), "kind")
    return ends.select("id", F.col("to").alias("survivor"), fault.alias("fault"))


def merged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, retired) after retired ids give way to their survivors everywhere; self-edges and repeats go."""
    gone = retired(nodes)
    good = written(gone.where("fault is null").select("id", "survivor"), "gone")
    if good.isEmpty():
        return nodes, edges, gone
    good = unsized(good)

    def renamed(df: DataFrame, column: str) -> DataFrame:
        to = good.select(F.col("id").alias("__from"), F.col("survivor").alias("__to"))
        # rows without a name are dealt out by what they are, not all to one task; what they find is no name of theirs
        own = F.col(f"`{column}`")
        dealt = F.coalesce(own, F.concat(F.lit("\0"), F.xxhash64(*df.columns[:2]).cast("string")))
        return df.join(to, dealt == F.col("__from"), "left").withColumn(column, F.when(own.isNotNull(), F.coalesce("__to", own))).drop("__from", "__to")

    for c in ("src", "dst", "while"):
        edges = renamed(edges, c)
    edges = first_declared(edges.where("src <> dst"), *EDGE_KEY)
    named = unsized(nodes.select("id", "aliases")).join(good, "id").select(F.col("survivor").alias("id"), "aliases").groupBy("id").agg(F.flatten(F.collect_list("aliases")).alias("more"))
    nodes = nodes.join(good.select("id"), "id", "left_anti").join(unsized(named), "id", "left")
    nodes = nodes.withColumn("aliases", F.concat("aliases", F.coalesce("more", F.array().cast(nodes.schema["aliases"].dataType)))).drop("more")
    for c in ("while", "owner"):
        nodes = renamed(nodes, c)
    return nodes, edges, gone


def incidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge under both of its ends (``nid``), only where both ends exist."""
    ids = unsized(nodes.select("id"))
    there = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return there.withColumn("nid", F.explode(F.array("src", "dst")))


def _part(c) -> F.Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def with_hashes(nodes: DataFrame, incident: DataFrame) -> DataFrame:
    """``nodes`` with sem_hash (what a node means with its edges) and cid (kind and normalized body).

    The layout of sem_hash is fixed: parts closed by NUL, sorted aliases, premises and edge digests. Digests are sorted in a node's own
    aggregate; a node with very many edges has them all in that one buffer, which its definition as one hash asks for.
    """
    zero = F.lit("\0")
    digest = F.concat_ws("\0", F.col("type"), F.col("src"), F.col("dst"), *(_part(F.col(f"`{c}`")) for c in ("valid_from", "valid_until", "while")))
    digest = F.concat(digest, F.when(F.col("one_way"), F.lit("\0001way")).otherwise(""), F.when(F.col("because").isNotNull(), F.concat(F.lit("\0because="), "because")).otherwise(""))
    by_node = incident.groupBy(F.col("nid").alias("id")).agg(F.sort_array(F.collect_list(digest)).alias("digests"))
    rows = nodes.join(unsized(by_node), "id", "left")
    closed = lambda items: F.coalesce(F.array_join(F.transform(items, lambda x: F.concat(x, zero)), ""), F.lit(""))
    c = lambda k: _part(F.col(f"`{k}`"))
    flag = lambda k: F.when(F.col(k), "true").otherwise("false")
    parts = [c(k) for k in ("kind", "body", "status", "owner", "valid_from", "valid_until", "at", "from", "to", "at_expr", "precision", "while", "group_expr", "value_expr", "unit")]
    parts += [shortest_number(F.col("value")), F.concat(flag("ordered"), F.lit("|"), flag("exhaustive")), c("needs"), c("underdetermined")]
    aliases = F.array_sort(F.transform("aliases", lambda a: F.concat_ws("\0", a["as"], _part(a["from"]), _part(a["until"]))))
    source = F.concat(*(F.concat(c(k), zero) for k in ("form", "class", "speaker", "medium", "doc", "anchor")), flag("recorded"), zero, closed(F.array_sort("premises")))
    text = F.concat(*(F.concat(p, zero) for p in parts), closed(aliases), F.when(F.col("kind") == "source", source).otherwise(""), closed(F.coalesce("digests", F.array().cast("array<string>"))))
    cid = F.substring(F.sha2(F.concat("kind", zero, F.coalesce(normalized(F.col("body")), F.lit(""))), 256), 1, 16)
    return rows.withColumns({"sem_hash": F.substring(F.sha2(text, 256), 1, 16), "cid": cid}).drop("digests")


def edge_cid() -> F.Column:
    """An edge's content id from its ends and type."""
    return F.substring(F.sha2(F.concat_ws("\0", "src", "type", "dst"), 256), 1, 16)


def aliases(nodes: DataFrame) -> DataFrame:
    """(name, id, from, until): every name with the half-open window in which it denotes a node."""
    return nodes.select("id", F.explode("aliases").alias("a")).select(F.col("a.as").alias("name"), "id", F.col("a.from").alias("from"), F.col("a.until").alias("until"))


def denotes(at) -> F.Column:
    """Whether an alias's half-open window holds a date; without a date every binding does."""
    return at.isNull() | ((F.col("`from`").isNull() | (F.col("`from`") <= at)) & (F.col("until").isNull() | (at < F.col("until"))))


def resolved(refs: DataFrame, nodes: DataFrame, gone: DataFrame, names: DataFrame) -> DataFrame:
    """``refs(ref, at)`` with the id each denotes at its date and how many bindings were found.

    An id denotes itself, a retired id its survivor, else the aliases in force count; no binding leaves the text as it is, and ``n``
    over 1 is ambiguous. All joins are by equality of the name, the window is a filter on top.
    """
    own = refs.join(nodes.select(F.col("id").alias("ref"), F.lit(True).alias("own")), "ref", "left")
    own = own.join(gone.where("fault is null").select(F.col("id").alias("ref"), "survivor"), "ref", "left")
    found = own.select("ref", "at").distinct().join(names.withColumnRenamed("id", "named"), F.col("ref") == F.col("name")).where(denotes(F.col("at")))
    bound = found.groupBy("ref", "at").agg(F.countDistinct("named").alias("n"), F.min("named").alias("named")).withColumnsRenamed({"ref": "r", "at": "a"})
    out = own.join(bound, (F.col("ref") == F.col("r")) & F.col("at").eqNullSafe(F.col("a")), "left")
    sure = F.col("own").isNotNull() | F.col("survivor").isNotNull()
    return out.select("ref", "at", F.when(F.col("own").isNotNull(), F.col("ref")).otherwise(F.coalesce("survivor", F.when(F.col("n") == 1, F.col("named")), "ref")).alias("id"), F.when(sure, 1).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


def alias_conflicts(names: DataFrame) -> DataFrame:
    """(name, a, b, overlap): names bound to two nodes, and whether the windows overlap. Neighbours in time are compared, not all pairs.

    Sorted by start, a binding overlaps an earlier one exactly if it starts before the largest end so far.
    """
    w = Window.partitionBy("name").orderBy(F.coalesce("`from`", F.lit("")), F.coalesce("until", F.lit("~")), "id")
    ended = F.max(F.struct(F.coalesce("until", F.lit("~")).alias("until"), "id")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = names.withColumn("before", ended).where("before is not null and before.id <> id")
    return rows.select("name", F.col("before.id").alias("a"), F.col("id").alias("b"), (F.coalesce("`from`", F.lit("")) < F.col("before.until")).alias("overlap"))


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, item, n): counts by kind and class, citations per fact up to 5, unreferenced sources, contradictions, open and withdrawn."""
    label = lambda m, item: (F.lit(m).alias("measure"), item.alias("item"))
    count = F.count("*").alias("n")
    cited = edges.where("type = 'attests'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c"))
    facts = nodes.where("kind <> 'source'").join(cited, "id", "left").select(F.least(F.coalesce("c", F.lit(0)), F.lit(5)).cast("string").alias("c"))
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = [
        nodes.groupBy(*label("kind", F.col("kind"))).agg(count),
        nodes.where("kind = 'source'").groupBy(*label("class", F.coalesce("class", F.lit("unclassed")))).agg(count),
        facts.groupBy(*label("citations", F.col("c"))).agg(count),
        nodes.where("kind = 'source'").join(used, "id", "left_anti").groupBy(*label("unreferenced", F.lit("source"))).agg(count),
        edges.where("type = 'contradicts'").groupBy(*label("contradictions", F.lit("edge"))).agg(count),
        nodes.where("kind = 'question' and status = 'open'").groupBy(*label("open", F.lit("question"))).agg(count),
        nodes.where("status = 'withdrawn'").groupBy(*label("withdrawn", F.lit("node"))).agg(count),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
