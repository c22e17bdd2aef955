"""Recorded answers: pins, drift, differences, hypothetical changes and variants."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.graph import incidence, with_hashes
from evigraph.plans import query as Q
from evigraph.plans.compile import Graph
from evigraph.sources.shared import unsized, written


def query_hash(text: str) -> str:
    """The hash of a query's text with its white space made single."""
    return "sha256:" + hashlib.sha256(" ".join(text.split()).encode()).hexdigest()[:16]


def hashed(g: Graph) -> DataFrame:
    """(id, sem_hash) of all nodes."""
    return g._once(("hashes",), lambda: with_hashes(g.nodes, incidence(g.nodes, g.edges)).select("id", "kind", "sem_hash"))


def cited(g: Graph, ids: DataFrame) -> DataFrame:
    """(id): the sources in a set, and those that attest or contradict one of its rows."""
    near = g.edges.where(F.col("type").isin("attests", "contradicts")).join(unsized(ids).withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return ids.union(near).distinct().join(unsized(g.nodes.where("kind = 'source'").select("id")), "id", "left_semi")


def _lines(g: Graph, q) -> tuple[Iterator[str], Iterator[str], Iterator[str]]:
    """The lines of an answer: its rows in order with their hashes, open questions, cited sources with theirs. Joined and sorted by Spark and read
    by partition, so an answer of any size passes through the driver without being held there."""
    line = hashed(g).select("id", F.concat("id", F.lit("@"), "sem_hash").alias("line"))
    rows = written(unsized(line).join(unsized(g.eval(q)), "id", "left_semi"), "answer")
    ids = rows.select("id")
    holes = g.taint().join(unsized(ids), "id", "left_semi").select(F.col("question").alias("line")).distinct()
    cites = unsized(cited(g, ids)).join(unsized(line), "id").select("line")
    return _read(g.in_order(q, rows)), _read(holes.orderBy("line")), _read(cites.orderBy("line"))


def _read(lines: DataFrame) -> Iterator[str]:
    for r in lines.toLocalIterator():
        yield r["line"]


def _set_hash(*parts: Iterable[str]) -> str:
    """The hash of all lines, which line feeds part."""
    h, between = hashlib.sha256(), ""
    for x in chain(*parts):
        h.update((between + x).encode())
        between = "\n"
    return "sha256:" + h.hexdigest()[:16]


def pin(g: Graph, text: str) -> dict:
    """The answer to a query as it is recorded: rows in order with their hashes, open questions, cited sources, and a hash over all.

    A pin is one record that holds its whole answer, so it is made for answers that people read.
    """
    q = g.checked(text)
    nodes, holes, cites = map(list, _lines(g, q))
    keys = [k.key for k in q.sort] if isinstance(q, Q.Pattern) and q.sort else ["id"]
    return {"set_hash": _set_hash(nodes, holes, cites), "count": len(nodes), "sort": keys, "nodes": nodes, "unresolved": holes, "cites": cites}


def split_pin(nodes: list[str]) -> dict[str, str]:
    """Each pinned id with its hash, in order."""
    return {x.rpartition("@")[0] or x: x.rpartition("@")[2] for x in nodes}


def difference(before: dict | None, after: dict | None) -> dict:
    """What moved between two pins: added, removed, changed, answered and new open questions, order, and the ends."""
    before, after = before or {"nodes": [], "unresolved": [], "count": 0}, after or {"nodes": [], "unresolved": [], "count": 0}
    old, new = split_pin(before["nodes"]), split_pin(after["nodes"])
    a, b = list(old), list(new)
    ends = lambda k: (a[k], b[k]) if a and b and a[k] != b[k] else None
    added, removed = sorted(set(b) - set(a)), sorted(set(a) - set(b))
    return {
        "count": (before["count"], after["count"]), "added": added, "removed": removed, "changed": [x for x in a if x in new and old[x] != new[x]],
        "resolved": [x for x in before["unresolved"] if x not in after["unresolved"]], "new_holes": [x for x in after["unresolved"] if x not in before["unresolved"]],
        "reordered": not added and not removed and a != b, "first": ends(0), "last": ends(-1),
    }


def difference_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, movement) between two resolutions ``(id, sem_hash)`` of any size: one full outer join."""
    x, y = before.select("id", F.col("sem_hash").alias("h0")), after.select("id", F.col("sem_hash").alias("h1"))
    kind = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return x.join(y, "id", "full").select("id", kind.alias("movement")).where("movement is not null")


def drift(g: Graph, text: str, recorded: dict | None, dialect_hash: str = "", recorded_query: str | None = None, recorded_dialect: str = "", drifted: tuple[str, ...] = ()) -> list[str]:
    """Why a recorded answer no longer stands: never-asked, query-changed, results-changed, dialect-changed, source-changed; or fresh."""
    if recorded is None:
        return ["never-asked"]
    out = []
    q = g.checked(text)
    if recorded_query is not None and recorded_query != query_hash(text):
        out.append("query-changed")
    if _set_hash(*_lines(g, q)) != recorded["set_hash"]:
        out.append("results-changed")
    if recorded_dialect != dialect_hash:
        out.append("dialect-changed")
    if drifted and not cited(g, g.eval(q)).where(F.col("id").isin(*drifted)).isEmpty():
        out.append("source-changed")
    return out or ["fresh"]


def statements(name: str, d: dict) -> list[str]:
    """A difference in sentences."""
    few = lambda xs: ", ".join(xs)
    out = []
    if d["count"][0] != d["count"][1]:
        out.append(f"{name}: {d['count'][0]} rows became {d['count'][1]}")
    for key, verb in (("added", "gained"), ("removed", "lost"), ("changed", "has changed rows"), ("resolved", "no longer waits for"), ("new_holes", "now waits for")):
        if d[key]:
            out.append(f"{name} {verb}: {few(d[key])}")
    if d["reordered"]:
        out.append(f"{name} has another order")
    for key in ("first", "last"):
        if d[key]:
            out.append(f"{name}: the {key} row was {d[key][0]} and is {d[key][1]}")
    return out


def what_if(g: Graph, overlay_nodes: DataFrame, overlay_edges: DataFrame) -> Graph:
    """A graph in which overlay nodes replace those with their ids together with the edges these own; retired ids and names stay."""
    ids = unsized(overlay_nodes.select("id"))
    nodes = g.nodes.join(ids, "id", "left_anti").unionByName(overlay_nodes, allowMissingColumns=True)
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(overlay_edges, allowMissingColumns=True)
    return Graph(written(nodes, "overlay"), written(edges, "overlay"), g.dialect, g.now, g.named, g.gone, g.names)


def would_change(g: Graph, other: Graph, declared: dict[str, str]) -> dict[str, dict]:
    """The difference of each declared query between two graphs; those without any are left out."""
    out = {}
    for name, text in declared.items():
        d = difference(pin(g, text), pin(other, text))
        if statements(name, d):
            out[name] = d
    return out


def variants(g: Graph, declared: dict[str, str]) -> DataFrame:
    """(question, option, name, statement): for every open question with options, what each option would move if it were taken."""
    spark = g.nodes.sparkSession
    open_q = g.nodes.where("kind = 'question' and status = 'open' and size(options) > 0").select("id", "options").collect()
    out = []
    for q in open_q:
        for option in q["options"]:
            taken = g.nodes.where(F.col("id").isin(option, q["id"])).withColumn("status", F.when(F.col("id") == option, "asserted").otherwise("resolved"))
            other = what_if(g, taken, g.edges.where(F.col("src").isin(option, q["id"])))
            for name, d in would_change(g, other, declared).items():
                out += [(q["id"], option, name, s) for s in statements(name, d)]
    return spark.createDataFrame(out, "question string, option string, name string, statement string")


def facts_used(pins: dict[str, dict], spark) -> DataFrame:
    """(id, names): every pinned or cited node with the declared queries that use it."""
    rows = [(x, name) for name, p in pins.items() for x in {**split_pin(p["nodes"]), **split_pin(p["cites"])}]
    return spark.createDataFrame(rows, "id string, name string").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))
