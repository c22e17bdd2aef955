"""Writes that are checked before anything is appended: all or nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import normalized
from evigraph.operators import checks, entries, graph
from evigraph.operators.fold import _rows, amending, fold, last_fields
from evigraph.sources import log as logs
from evigraph.sources.dialect import LEGAL, Dialect
from evigraph.sources.shared import written


class Refused(ValueError):
    """A write that would leave a log that doesn't load."""


def trial(log: DataFrame, new: DataFrame, dialect: Dialect = LEGAL) -> DataFrame:
    """(check, severity, subjects, message): what is wrong with the graph of a log with new rows behind it.

    The whole log is folded, parsed, merged and checked, each in plans; only findings come out.
    """
    folded = written(fold(behind(log, new)), "trial")
    nodes, edges = entries.nodes(folded, dialect), entries.edges(folded, dialect)
    lost = graph.retired(nodes).where("fault is not null")
    parts = [
        entries.faults(folded, dialect), checks.dangling(nodes, edges), checks.anchor_layers(nodes, edges), checks.repeated_edges(edges),
        checks.found(lost, "retired", "error", F.array("id", "survivor"), F.concat(F.lit("can't be retired: "), F.col("fault"))),
        checks.alias_clashes(graph.aliases(nodes)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.select(*out.columns))
    return out


def behind(log: DataFrame, new: DataFrame) -> DataFrame:
    """A log with new rows numbered after its last one."""
    last = log.agg(F.max("pos")).first()[0]
    return log.unionByName(new.withColumn("pos", F.col("pos") + F.lit((last if last is not None else -1) + 1)).select(*log.columns))


def apply(log: DataFrame, new: DataFrame, append: Callable[[DataFrame], None], dialect: Dialect = LEGAL) -> DataFrame:
    """Append new assertions by ``append`` if each is well formed and the whole log still loads; returns the warnings.

    Refused names the first few errors, and nothing is appended then. Errors that the log has already refuse a write as well.
    """
    if new.isEmpty():
        return checks._none(log)
    bad = logs.faults(new).limit(5).collect()
    if bad:
        raise Refused("; ".join(f"{r['id']}: {r['why']}" for r in bad))
    found = written(trial(log, new, dialect), "trial")
    wrong = found.where("severity = 'error'").orderBy("check", "message").limit(5).collect()
    if wrong:
        raise Refused("that would not load: " + "; ".join(f"{', '.join(r['subjects'])}: {r['message']}" for r in wrong))
    append(new)
    return found.where("severity <> 'error'")


def adding_alias(log: DataFrame, nodes: DataFrame, target: str, alias: str, by: str, at: str) -> DataFrame:
    """The assertion that gives a node one more name.

    Refused: an unknown node, an empty name, one that the node has already after normalization, and one that denotes another node.
    """
    if nodes.where(F.col("id") == target).isEmpty():
        raise Refused(f"no node {target!r}")
    if not alias.strip():
        raise Refused("an empty alias names nothing")
    names = graph.aliases(nodes)
    own = names.where((F.col("id") == target) & (normalized(F.col("name")) == normalized(F.lit(alias)))).first()
    if own:
        raise Refused(f"{target!r} has the alias {own['name']!r} already")
    other = names.where((F.col("name") == alias) & (F.col("id") != target)).first()
    if other:
        raise Refused(f"{alias!r} denotes {other['id']!r} already: date both by hand")
    last = last_fields(log.where(F.col("id") == target)).first()
    if not last:
        raise Refused(f"{target!r} was never asserted")
    import json

    said = last["fields"].get("aliases") or ""
    items = json.loads(said) if said.startswith("[") else [said] if said else []
    items = [json.loads(x) if isinstance(x, str) and x.startswith("{") else x for x in items]
    return amending(log, target, {"aliases": json.dumps([*items, {"as": alias}], ensure_ascii=False)}, by, at)


def relocating(log: DataFrame, moved: DataFrame, by: str, at: str) -> DataFrame:
    """The assertions that point sources at their documents' new places: ``moved(id, old, new)``, of which rows without a sole match are left out.

    Each restates its source's last fields with the new ``doc``; one join, however many documents moved.
    """
    last = last_fields(log)
    rows = moved.where("new is not null").join(last, "id")
    fields = F.map_concat(F.map_filter("fields", lambda k, _: k != "doc"), F.create_map(F.lit("doc"), F.col("new")))
    none = F.lit(None).cast("string")
    said = {"op": F.lit("assert"), "id": F.col("id"), "fields": fields, "reason": none, "into_id": none, "note": F.concat(F.lit("moved from "), F.col("old")), "by_who": F.lit(by), "at": F.lit(at), "pos": F.monotonically_increasing_id()}
    return rows.select(*(c.alias(k) for k, c in said.items()))


def imported(log: DataFrame, other: DataFrame) -> DataFrame:
    """A log with another one behind it, in that one's order; what both have stands twice, which a fold doesn't mind."""
    return behind(log, other)


def indexes(table: DataFrame) -> DataFrame:
    """(idx, assertions, ids, last_at) of each index of a table of logs."""
    return table.groupBy("idx").agg(F.count("*").alias("assertions"), F.countDistinct("id").alias("ids"), F.max("at").alias("last_at"))


def stated(spark, entries_: list[dict], by: str, at: str) -> DataFrame:
    """Assertions of entries read from text: each a map with an id."""
    return _rows(spark, [("assert", e["id"], {k: v for k, v in e.items() if k != "id"}, None, None, None, by, at) for e in entries_])
