"""Queries to DataFrame plans.

A pattern becomes a chain of left semi-joins from its last atom to its first, which is exact for existential paths: the result are the
ids of the leftmost atom. Nodes and edges are tables by kind and type, not unions: semi-joins would be pushed into each part of a union, and
each hop would multiply the plan. A starred hop is a backward search over sets. Atoms are filters on one node view, which joins resolved dates
and values, tension and satisfaction only where the query names them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.compare import compared, in_window, live, sort_keys
from evigraph.model import FLAG_FIELDS
from evigraph.operators import derive
from evigraph.operators.closure import reaching
from evigraph.plans import query as Q
from evigraph.sources.dialect import LEGAL, Dialect
from evigraph.sources.shared import unsized, written


@dataclass
class Graph:
    """What queries run on: typed nodes and edges of one index, its aliases and retired ids, a clock and named queries.

    Derived tables are made once for each date and kept in the shared folder as long as the object lives.
    """

    nodes: DataFrame
    edges: DataFrame
    dialect: Dialect = LEGAL
    now: str | None = None
    named: dict[str, object] = field(default_factory=dict)
    gone: DataFrame | None = None
    names: DataFrame | None = None
    #: Whether every edge is known to have both ends among the nodes.
    closed: bool = False
    _kept: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.closed:
            self.edges = closed(self.nodes, self.edges)

    def _none(self, key: str, test: str) -> bool:
        """Whether no node passes a test, asked once."""
        if key not in self._kept:
            self._kept[key] = self.nodes.where(test).isEmpty()
        return self._kept[key]

    def _once(self, key, make) -> DataFrame:
        if key not in self._kept:
            self._kept[key] = written(make(), str(key[0]))
        return self._kept[key]

    def gated(self) -> bool:
        """Whether any node or edge has a ``while``."""
        if "gated" not in self._kept:
            self._kept["gated"] = not (self.nodes.where("while is not null").isEmpty() and self.edges.where("while is not null").isEmpty())
        return self._kept["gated"]

    def holding(self, at: str | None) -> DataFrame:
        return self._once(("satisfied", at), lambda: derive.satisfied(self.nodes, self.edges, at))

    def live(self, at: str | None) -> DataFrame:
        return derive.live_edges(self.edges, self.holding(at) if at is not None and self.gated() else None, at)

    def dated(self) -> DataFrame:
        if self._none("no at_expr", "at_expr is not null"):
            return self.nodes.where("at is not null").select("id", "at")
        return self._once(("dates",), lambda: derive.dates(self.nodes))

    def valued(self) -> DataFrame:
        if self._none("no value_expr", "value is null and (value_expr is not null or group_expr like '%sum(%')"):
            return self.nodes.where("value is not null").select("id", "value")
        return self._once(("values",), lambda: derive.values(self.nodes, self.edges))

    def tension(self, at: str | None) -> DataFrame:
        return self._once(("tension", at), lambda: derive.tension(self.nodes, self.live(at), self.dialect.ranks(self.nodes.sparkSession)))

    def taint(self) -> DataFrame:
        return self._once(("taint", self.now), lambda: derive.taint(self.nodes, self.live(self.now)))

    def view(self, keys: set[str], at: str | None) -> DataFrame:
        """The nodes with the queryable fields in ``keys`` as string columns ``f_<key>``; flags are booleans."""
        v = self.nodes
        if "at" in keys and not self._none("no at_expr", "at_expr is not null"):
            v = v.withColumnRenamed("at", "authored_at").join(self.dated(), "id", "left")
        if "value" in keys and not self._none("no value_expr", "value is null and (value_expr is not null or group_expr like '%sum(%')"):
            v = v.withColumnRenamed("value", "authored_value").join(self.valued(), "id", "left")
        if keys & {"disputed", "impeached"}:
            v = v.join(self.tension(at).select("id", "tension"), "id", "left")
        flags = {
            "computed": F.col("at_expr").isNotNull() | F.col("value_expr").isNotNull(),
            **{k: F.coalesce(F.col("tension") == k, F.lit(False)) for k in ("disputed", "impeached")},
        } if keys & {"computed", "disputed", "impeached"} else {}
        number = F.col("value")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        texts = {"value": F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))} if "value" in keys else {}
        source_only = ("class", "speaker", "medium")
        for k in keys:
            if k in flags:
                c = flags[k]
            elif k in source_only:
                c = F.when(F.col("form").isNotNull(), F.col(k))
            else:
                c = texts.get(k, F.col(f"`{k}`"))
            v = v.withColumn(f"f_{k}", c)
        return v

    def ref(self, name: str, at: str | None) -> str:
        """The id that a name denotes at a date; an ambiguous one raises, an unknown one stays as it is."""
        if not self.nodes.where(F.col("id") == name).isEmpty():
            return name
        if self.gone is not None and (r := self.gone.where((F.col("id") == name) & F.col("fault").isNull()).first()):
            return r["survivor"]
        if self.names is None:
            return name
        from evigraph.operators.graph import denotes

        found = [r["id"] for r in self.names.where(F.col("name") == name).where(denotes(F.lit(at))).select("id").distinct().limit(2).collect()]
        if len(found) > 1:
            raise Q.QueryError(f"{name!r} denotes several nodes; give a date")
        return found[0] if found else name

    def date_of(self, when: Q.When | None) -> str | None:
        if when is None:
            return None
        return self.now if when.now else when.start

    def eval(self, q, inherit: Q.When | None = None, seen: tuple[str, ...] = ()) -> DataFrame:
        """(id): the set that a query denotes, without an order."""
        if isinstance(q, str):
            q = self.checked(q)
        if isinstance(q, Q.Scoped):
            return self.eval(q.inner, q.at or inherit, seen)
        if isinstance(q, Q.Named):
            if q.name in seen:
                raise Q.QueryError(f"named query {q.name!r} is recursive")
            if q.name not in self.named:
                raise Q.QueryError(f"unknown named query @{q.name}")
            sub = self.named[q.name]
            return self.eval(Q.parse(sub) if isinstance(sub, str) else sub, inherit, (*seen, q.name))
        if isinstance(q, Q.Not):
            return self.nodes.select("id").join(unsized(self.eval(q.inner, inherit, seen)), "id", "left_anti")
        if isinstance(q, Q.And):
            first, *rest = (self.eval(t, inherit, seen) for t in q.terms)
            for t in rest:
                first = first.join(unsized(t), "id", "left_semi")
            return first
        if isinstance(q, Q.Or):
            first, *rest = (self.eval(t, inherit, seen) for t in q.terms)
            for t in rest:
                first = first.union(t)
            return first.distinct()
        return self._pattern(q, q.at or inherit)

    def checked(self, text: str):
        q = Q.parse(text)
        if wrong := Q.problems(q, self.dialect.classes, self.dialect.edges):
            raise Q.QueryError("; ".join(wrong))
        return q

    def _pattern(self, p: Q.Pattern, when: Q.When | None) -> DataFrame:
        at = self.date_of(when)
        live_edges = self.live(at) if p.hops else None
        matched = self._atom(p.atoms[-1], at, when if not p.hops else None)
        if p.hops and not p.atoms[-1].ref:  # else it is one id at most
            matched = unsized(matched)
        for atom, hop, k in zip(reversed(p.atoms[:-1]), reversed(p.hops), range(len(p.hops) - 1, -1, -1), strict=True):
            e = live_edges.where(F.col("type") == hop.edge).select("src", "dst")
            if hop.direction == -1:
                e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            elif hop.direction == 0:
                e = e.union(e.select("dst", "src"))
            if hop.star:
                left = reaching(e, matched)
            else:
                left = e.join(matched.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
            matched = self._atom(atom, at, when if k == 0 else None).join(unsized(left), "id", "left_semi")
            if k > 0:
                matched = unsized(matched)
        return matched

    def _atom(self, a: Q.Atom, at: str | None, when: Q.When | None) -> DataFrame:
        windowed = when is not None and when.window
        v = self.view({p.key for p in a.preds} | ({"at"} if windowed else set()), at)
        test = F.lit(True)
        if a.kinds:
            test = test & F.col("kind").isin(*a.kinds)
        if a.ref:
            test = test & (F.col("id") == self.ref(a.ref, at))
        if a.text:
            test = test & F.contains(F.lower("body"), F.lit(a.text.lower()))
        for p in a.preds:
            test = test & self._pred(p)
        if windowed:
            test = test & in_window(F.col("f_at"), F.lit(when.start), F.lit(when.end))
        if at is not None:
            test = test & live(F.lit(at), F.col("valid_from"), F.col("valid_until"))
        v = v.where(test)
        if at is not None and self.gated():
            ok = self.holding(at).where("ok").select(F.col("id").alias("while"))
            v = v.where("while is null").select("id").union(v.where("while is not null").join(ok, "while", "left_semi").select("id"))
        return v.select("id")

    def _pred(self, p: Q.Pred) -> Column:
        c = F.col(f"f_{p.key}")
        if p.key in FLAG_FIELDS:
            return c if p.op == "has" else (c == F.lit(p.values[0] == "true")) if p.op == "=" else (c != F.lit(p.values[0] == "true"))
        if p.op == "has":
            return c.isNotNull()
        values = [F.lit(self.now if v == "now" else v) for v in p.values]
        if p.op == "in":
            return c.isin(*(self.now if v == "now" else v for v in p.values))
        if p.op == "=":
            return c == values[0]
        if p.op == "!=":
            return c != values[0]
        return compared(c, values[0], p.op)

    def order(self, q) -> tuple[tuple[Q.SortKey, ...], Q.When | None]:
        """The declared order of a query and the date its keys are read at; sets have none."""
        if isinstance(q, Q.Scoped):
            return (q.sort, q.at) if q.sort else self.order(q.inner)
        if isinstance(q, Q.Named) and q.name in self.named:
            sub = self.named[q.name]
            return self.order(Q.parse(sub) if isinstance(sub, str) else sub)
        return (q.sort, q.at) if isinstance(q, Q.Pattern) else ((), None)

    def _sorted(self, v: DataFrame, keys: tuple[Q.SortKey, ...]) -> DataFrame:
        order = []
        for k in keys:
            order += sort_keys(F.col(f"f_{k.key}").cast("string"), k.descending)
        return v.orderBy(*order, "id")

    def _ordered(self, q, columns: tuple[str, ...]) -> DataFrame:
        q = self.checked(q) if isinstance(q, str) else q
        ids = self.eval(q)
        keys, when = self.order(q)
        v = self.view({k.key for k in keys}, self.date_of(when)).join(unsized(ids), "id", "left_semi")
        return self._sorted(v, keys).select(*columns)

    def in_order(self, q, rows: DataFrame) -> DataFrame:
        """``rows(id, ...)`` of a query's result in its declared order, then by id."""
        keys, when = self.order(q)
        if not keys:
            return rows.orderBy("id")
        v = self.view({k.key for k in keys}, self.date_of(when)).select("id", *{f"f_{k.key}" for k in keys})
        return self._sorted(unsized(v).join(unsized(rows), "id"), keys).select(*rows.columns)

    def run(self, q) -> DataFrame:
        """(id) in the query's declared order, then by id; absent keys last in both directions. A range sort, not one task."""
        return self._ordered(q, ("id",))

    def rows(self, q) -> DataFrame:
        """id, kind and body of a query's result, in its declared order, then by id: joined first and sorted last."""
        return self._ordered(q, ("id", "kind", "body"))


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that have both ends among the nodes."""
    ids = unsized(nodes.select("id"))
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def load(log: DataFrame, dialect: Dialect = LEGAL, now: str | None = None, named: dict | None = None) -> Graph:
    """A graph from a log: fold, parse, merge, dedupe. What is wrong with it, the checks say."""
    from evigraph.operators import entries, graph
    from evigraph.operators.fold import fold

    folded = written(fold(log), "folded")
    nodes = written(graph.first_declared(entries.nodes(folded, dialect), "id"), "nodes")
    edges = written(graph.first_declared(entries.edges(folded, dialect), *graph.EDGE_KEY), "edges")
    nodes, edges, gone = graph.merged(nodes, edges)
    nodes = written(nodes, "graph", by="kind")
    edges = written(closed(nodes, edges).select(*(F.col(f"`{c}`") for c in edges.columns)), "graph", by="type")
    return Graph(nodes, edges, dialect, now, named or {}, gone, written(graph.aliases(nodes), "names"), closed=True)
