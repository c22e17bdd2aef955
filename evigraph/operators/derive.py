"""Derived columns: values, dates, satisfaction, conflict and dependence on open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.compare import NUMBER, live, shifted, windows_overlap
from evigraph.model import HOLDING
from evigraph.operators.closure import components, reached_from
from evigraph.sources.shared import written

_TERM = r"^([A-Za-z_][\w-]*)\.(value|at)$"


def _bare(expr: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(expr), "^=", ""))


def terms(expr: Column) -> Column:
    """``= a + b - c`` as structs of sign and operand; NULL for text that isn't a flat sum. Patterns only: lambdas aren't compiled."""
    e = _bare(expr)
    led = F.concat(F.lit("+ "), e)
    found = [F.regexp_extract_all(led, F.lit(r"([+-])\s+(\S+)"), k).alias(n) for k, n in ((1, "sign"), (2, "operand"))]
    return F.when(e.rlike(r"^\S+(?:\s+[+-]\s+\S+)*$"), F.arrays_zip(*found))


def values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value) of every node that has one: authored, a sum over a group's members, or an expression of others.

    Only nodes with a rule take part in the rounds. A group sums the members that have a value, whatever its member edges' dates say; an
    expression with any missing term has none, and a cycle has none. Each round resolves what depends on settled nodes only.
    """
    known = nodes.where("value is not null").select("id", "value")
    rule = nodes.where("value is null")
    sums = rule.where(F.col("group_expr").rlike(r"^\s*sum\(.*\)\s*$")).join(edges.where("type = 'member_of'").select("src", F.col("dst").alias("id")), "id").select("id", F.col("src").alias("on"), F.lit(1.0).alias("sign"), F.lit(True).alias("optional"))
    said = rule.where("value_expr is not null and kind <> 'group'").select("id", terms(F.col("value_expr")).alias("t")).select("id", F.posexplode("t").alias("k", "t"))
    ref = F.regexp_extract("t.operand", _TERM, 1)
    is_ref = F.regexp_extract("t.operand", _TERM, 2) == "value"
    sign = F.when(F.col("t.sign") == "-", -1.0).otherwise(1.0)
    exprs = said.select("id", F.when(is_ref, ref).alias("on"), F.when(F.col("t.operand").rlike(NUMBER), F.col("t.operand").cast("double")).alias("literal"), sign.alias("sign"), F.lit(False).alias("optional"))
    deps = sums.withColumn("literal", F.lit(None).cast("double")).unionByName(exprs)
    deps = written(deps, "values")
    if deps.isEmpty():
        return known
    open_ids = deps.select(F.col("id").alias("on")).distinct()
    settled = written(known, "values")
    done = None
    while True:
        # what is still open among the things that a node depends on
        have = settled.select(F.col("id").alias("on"), F.col("value").alias("v"))
        waiting = open_ids if done is None else open_ids.join(done.select(F.col("id").alias("on")), "on", "left_anti")
        rows = deps.join(have, "on", "left").join(waiting.withColumn("waits", F.lit(True)), "on", "left")
        if done is not None:
            rows = rows.join(done.select("id"), "id", "left_anti")
        v = F.coalesce("literal", "v")
        new = rows.groupBy("id").agg(
            F.max(F.coalesce("waits", F.lit(False))).alias("waits"), F.sum(F.col("sign") * v).alias("value"), F.max(v.isNull() & ~F.col("optional")).alias("missing")
        ).where("not waits").select("id", F.when(~F.col("missing"), F.col("value")).alias("value"))
        new = written(new, "values")
        if new.isEmpty():
            break
        done = new.select("id") if done is None else done.union(new.select("id"))
        settled = settled.union(new.where("value is not null"))
    return settled


def _moved(d: Column, m: Column) -> Column:
    """A date moved by one struct of sign, n and unit."""
    n = m["n"].cast("int") * F.when(m["sign"] == "-", -1).otherwise(1)
    return shifted(d, *(F.when(m["unit"] == u, n).otherwise(0) for u in ("y", "mo", "d")))


def dates(nodes: DataFrame) -> DataFrame:
    """(id, at) of every node that has a date: authored, or another's full date moved by days, months and years.

    Chains are followed in rounds, a level each; a cycle resolves to nothing. Calendar units overflow rather than clamp.
    """
    known = nodes.where("at is not null").select("id", "at")
    e = _bare(F.col("at_expr"))
    move = r"\s+([+-])\s+([+-]?[0-9]+)(y|mo|d)(?!\S)"
    moves = F.arrays_zip(*(F.regexp_extract_all(e, F.lit(move), k).alias(n) for k, n in ((1, "sign"), (2, "n"), (3, "unit"))))
    flat = r"^[A-Za-z_][\w-]*\.at(?:\s+[+-]\s+[+-]?[0-9]+(?:y|mo|d))*$"
    rule = nodes.where("at is null and at_expr is not null").where(e.rlike(flat)).select("id", F.substring_index(e, ".at", 1).alias("on"), moves.alias("moves"))
    rule = written(rule, "dates")
    if rule.isEmpty():
        return known
    settled, frontier = known, known
    while True:
        have = frontier.where(F.col("at").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("at", "yyyy-MM-dd").isNotNull())
        rows = rule.join(have.select(F.col("id").alias("on"), F.to_date("at").alias("b")), "on")
        at = F.aggregate("moves", F.col("b"), _moved)
        frontier = written(rows.select("id", F.date_format(at, "yyyy-MM-dd").alias("at")), "dates")
        if frontier.isEmpty():
            return settled
        settled = settled.union(frontier)


def rule_holds(expr: Column, total: Column, satisfied: Column) -> Column:
    """Whether a group rule holds for so many members and satisfied ones."""
    e = F.btrim(expr)
    op, k = F.regexp_extract(e, r"^(>=|<=|==|>|<)\s*([0-9]+)$", 1), F.regexp_extract(e, r"^(>=|<=|==|>|<)\s*([0-9]+)$", 2).cast("long")
    return (
        F.when(e == "all", (total > 0) & (satisfied == total)).when(e == "any", satisfied >= 1).when(e == "none", satisfied == 0).when(e.startswith("sum("), total > 0)
        .when(op == ">=", satisfied >= k).when(op == ">", satisfied > k).when(op == "<=", satisfied <= k).when(op == "<", satisfied < k).when(op == "==", satisfied == k).otherwise(False)
    )


def _valid(at: str | None) -> Column:
    return F.lit(True) if at is None else live(F.lit(at), F.col("valid_from"), F.col("valid_until"))


def satisfied(nodes: DataFrame, edges: DataFrame, at: str | None = None) -> DataFrame:
    """(id, ok): whether each node holds at a date: status, validity, its ``while``, and for groups the rule over live members.

    Nodes without ``while`` that are no groups settle at once and never meet a join. The others settle in rounds once all they depend on
    has; what is left stands on cycles, where a node met again counts as false, and so does a member's gate that waits for its own
    answer: each connected rest is decided by that path rule in a grouped map, whatever its length.
    """
    status = F.col("status").isin(*HOLDING) & _valid(at)
    free = nodes.where((F.col("kind") != "group") & F.col("while").isNull()).select("id", F.coalesce(status, F.lit(False)).alias("ok"))
    rest = nodes.where((F.col("kind") == "group") | F.col("while").isNotNull()).select("id", "kind", "group_expr", "while", F.coalesce(status, F.lit(False)).alias("own"), F.coalesce(_valid(at), F.lit(False)).alias("valid"))
    if rest.isEmpty():
        return free
    rest = written(rest, "holds")
    member = edges.where("type = 'member_of'").where(_valid(at)).select(F.col("dst").alias("id"), F.col("src").alias("member"), (F.lit(None).cast("string") if at is None else F.col("while")).alias("gate"))
    members = written(member.join(rest.where("kind = 'group'").select("id"), "id", "left_semi"), "holds")
    settled = written(free, "holds")
    while True:
        todo = rest.join(settled.select("id"), "id", "left_anti")
        st = lambda name: settled.select(F.col("id").alias(name), F.col("ok").alias(f"{name}_ok"))
        m = members.join(st("member"), "member", "left").join(st("gate"), "gate", "left").join(nodes.select(F.col("id").alias("gate"), F.lit(True).alias("gate_known")), "gate", "left").join(nodes.select(F.col("id").alias("member"), F.lit(True).alias("known")), "member", "left")
        # a gate or member that is no node is false
        gate = F.when(F.col("gate").isNull(), True).when(F.col("gate_known").isNull(), False).otherwise(F.col("gate_ok"))
        ok = F.when(F.col("known").isNull(), False).otherwise(F.col("member_ok"))
        m = m.select("id", gate.alias("g"), ok.alias("o"))
        counts = m.groupBy("id").agg(F.sum(F.when(F.col("g"), 1).otherwise(0)).alias("total"), F.sum(F.when(F.col("g") & F.col("o"), 1).otherwise(0)).alias("sat"), F.max(F.col("g").isNull() | (F.col("g") & F.col("o").isNull())).alias("waits"))
        w = todo.join(st("while"), "while", "left").join(nodes.select(F.col("id").alias("while"), F.lit(True).alias("there")), "while", "left").join(counts, "id", "left")
        hold = F.when(F.col("while").isNull(), True).when(F.col("there").isNull(), False).otherwise(F.col("while_ok"))
        grp = F.when(F.coalesce("waits", F.lit(False)), None).otherwise(rule_holds(F.col("group_expr"), F.coalesce("total", F.lit(0)), F.coalesce("sat", F.lit(0))))
        own = F.when(F.col("kind") == "group", grp).otherwise(F.col("own"))
        # false settles as soon as any part is false
        out = F.when(~F.col("valid") | (hold == F.lit(False)) | (own == F.lit(False)), False).when(hold & own, True)
        new = written(w.select("id", out.alias("ok")).where("ok is not null"), "holds")
        if new.isEmpty():
            break
        settled = settled.union(new)
    todo = rest.join(settled.select("id"), "id", "left_anti")
    if todo.isEmpty():
        return settled
    return settled.union(_cycles(todo, members, settled))


def _cycles(todo: DataFrame, members: DataFrame, settled: DataFrame) -> DataFrame:
    """Decide the nodes that wait for each other, a connected rest at a time."""
    ids = todo.select("id")
    inside = members.join(ids, "id", "left_semi").join(settled.withColumnsRenamed({"id": "member", "ok": "member_ok"}), "member", "left").join(settled.withColumnsRenamed({"id": "gate", "ok": "gate_ok"}), "gate", "left")
    links = todo.where("while is not null").select(F.col("id").alias("a"), F.col("while").alias("b")).union(inside.select("id", "member")).union(inside.where("gate is not null").select("id", "gate"))
    links = links.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    comp = components(links.union(ids.select("id", "id"))).select("id", "component")
    grouped = inside.groupBy("id").agg(F.collect_list(F.struct("member", "member_ok", "gate", "gate_ok")).alias("members"))
    rows = todo.join(settled.withColumnsRenamed({"id": "while", "ok": "while_ok"}), "while", "left").join(grouped, "id", "left").join(comp, "id")

    def decide(pdf):
        import pandas as pd

        by = {r.id: r for r in pdf.itertuples()}

        def group_rule(expr, total, sat):
            import re

            e = (expr or "").strip()
            if e in ("all", "any", "none"):
                return {"all": total > 0 and sat == total, "any": sat >= 1, "none": sat == 0}[e]
            if e.startswith("sum("):
                return total > 0
            m = re.fullmatch(r"(>=|<=|==|>|<)\s*(\d+)", e)
            k = int(m[2]) if m else 0
            return bool(m) and {">=": sat >= k, ">": sat > k, "<=": sat <= k, "<": sat < k, "==": sat == k}[m[1]]

        def holds(node, fixed, path):
            if node not in by:
                return bool(fixed) if fixed is not None and fixed == fixed else False
            if node in path:
                return False
            path.add(node)
            ok = yield from judged(by[node], path)
            path.discard(node)
            return ok

        def judged(r, path):
            if not r.valid or (r[cols["while"]] is not None and not (yield r[cols["while"]], r.while_ok, path)):
                return False
            if r.kind != "group":
                return bool(r.own)
            # a member's gate is judged anew, as if asked for alone; one that waits for its own answer counts as false
            alive, sat = [], 0
            for m in r.members if r.members is not None else []:
                gate = m["gate"]
                if gate is None:
                    alive.append(m)
                elif gate not in gates:
                    gates.add(gate)
                    if (yield gate, m["gate_ok"], set()):
                        alive.append(m)
                    gates.discard(gate)
            for m in alive:
                sat += yield m["member"], m["member_ok"], path
            return group_rule(r.group_expr, len(alive), sat)

        def answer(node):
            # questions that wait for others stand on a list, so that a cycle's length isn't bounded by Python's stack
            open_, value = [holds(node, None, set())], None
            while open_:
                try:
                    open_.append(holds(*open_[-1].send(value)))
                    value = None
                except StopIteration as done:
                    open_.pop()
                    value = done.value
            return value

        cols, gates = {c: k + 1 for k, c in enumerate(pdf.columns)}, set()
        return pd.DataFrame({"id": list(by), "ok": [answer(x) for x in by]})

    return rows.groupBy("component").applyInPandas(decide, "id string, ok boolean")


def group_state(nodes: DataFrame, edges: DataFrame, at: str | None = None) -> DataFrame:
    """(id, total, satisfied, blocking, ok) of every group at a date; blocking members are sorted."""
    hold = written(satisfied(nodes, edges, at), "holds")
    member = live_edges(edges.where("type = 'member_of'"), hold, at).select(F.col("dst").alias("id"), F.col("src").alias("member"))
    m = member.join(hold.select(F.col("id").alias("member"), "ok"), "member", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    counts = m.groupBy("id").agg(F.count("*").alias("total"), F.sum(F.col("ok").cast("long")).alias("satisfied"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("member")))).alias("blocking"))
    out = nodes.where("kind = 'group'").select("id", "group_expr").join(counts, "id", "left")
    total, sat = F.coalesce("total", F.lit(0)), F.coalesce("satisfied", F.lit(0))
    return out.select("id", total.alias("total"), sat.alias("satisfied"), F.coalesce("blocking", F.array().cast("array<string>")).alias("blocking"), rule_holds(F.col("group_expr"), total, sat).alias("ok"))


def live_edges(edges: DataFrame, hold: DataFrame | None, at: str | None) -> DataFrame:
    """The edges that can be walked at a date: in their closed window, and their ``while`` satisfied. Without a date all can."""
    if at is None:
        return edges
    inside = edges.where(_valid(at))
    if hold is None:
        return inside.where("while is null")
    ok = hold.where("ok").select(F.col("id").alias("while"))
    return inside.where("while is null").unionByName(inside.where("while is not null").join(ok, "while", "left_semi").select(*(F.col(f"`{c}`") for c in inside.columns)))


def tension(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, tension, n_for, n_against, beaten_by) of nodes with one: underdetermined, impeached or disputed, in that precedence.

    ``edges`` are those live at the date asked about, ``ranks(class, rank)`` the ladder, a handful of rows. A node is disputed with a
    live attesting source and a contradicting source or a live, supported claim whose truth window overlaps; one-way edges hit only
    their target. It is impeached if the weakest ranked source with a speaker is outranked by a contradicting claim's source.
    """
    about = nodes.select("id", "kind", "status", "valid_from", "valid_until", "underdetermined")
    sources = nodes.where("kind = 'source'").select(F.col("id").alias("src"), "class", "speaker").join(F.broadcast(ranks), "class", "left").select("src", "rank", "speaker")
    attests = edges.where("type = 'attests'").select("src", "dst").join(sources, "src").groupBy(F.col("dst").alias("id")).agg(
        F.count("*").alias("n_for"), F.max("rank").alias("best"), F.min(F.when(F.col("speaker").isNotNull(), F.col("rank"))).alias("weakest")
    )
    attests = written(attests, "attests")
    con = edges.where("type = 'contradicts'").select("src", "dst", "one_way")
    by_source = con.join(sources.select("src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_sources"))
    claims = con.join(sources.select("src"), "src", "left_anti")
    # a source may stand at the far end too; it contests nothing itself
    faced = claims.select(F.col("dst").alias("id"), F.col("src").alias("other")).union(con.where("not one_way").select(F.col("src").alias("id"), F.col("dst").alias("other"))).where("id <> other")
    me = about.select("id", F.col("valid_from").alias("f1"), F.col("valid_until").alias("u1"))
    them = about.where((F.col("kind") != "source") & F.col("status").isin("asserted", "proposed")).join(attests.select("id", F.col("best").alias("o_best")), "id").select(F.col("id").alias("other"), F.col("valid_from").alias("f2"), F.col("valid_until").alias("u2"), "o_best")
    pairs = faced.join(them, "other").join(me, "id").where(windows_overlap(F.col("f1"), F.col("u1"), F.col("f2"), F.col("u2"))).join(attests.select("id", "weakest"), "id", "left")
    contested = pairs.groupBy("id").agg(F.count("*").alias("n_claims"), F.sort_array(F.collect_set(F.when(F.col("o_best") > F.col("weakest"), F.col("other")))).alias("beaten_by"))
    rows = about.where((F.col("kind") != "source") & F.coalesce(~F.col("status").isin("withdrawn", "false"), F.lit(True))).join(attests.select("id", "n_for"), "id", "left").join(by_source, "id", "left").join(contested, "id", "left")
    against = F.coalesce("n_sources", F.lit(0)) + F.coalesce("n_claims", F.lit(0))
    both = (F.coalesce("n_for", F.lit(0)) > 0) & (against > 0)
    kind = F.when(F.col("underdetermined").isNotNull(), "underdetermined").when(both & (F.size(F.coalesce("beaten_by", F.array().cast("array<string>"))) > 0), "impeached").when(both, "disputed")
    return rows.select("id", kind.alias("tension"), F.coalesce("n_for", F.lit(0)).alias("n_for"), against.alias("n_against"), F.coalesce("beaten_by", F.array().cast("array<string>")).alias("beaten_by")).where("tension is not null")


def depends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): what each node rests on: requires, a group's members, and ``while``; open questions rest on nothing."""
    kinds = nodes.select("id", "kind", "status", "while")
    groups = kinds.where("kind = 'group'").select(F.col("id").alias("dst"))
    out = edges.where("type = 'requires'").select("src", "dst").union(edges.where("type = 'member_of'").join(groups, "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).union(kinds.where("while is not null").select("id", "while"))
    stop = kinds.where("kind = 'question' and status = 'open'").select(F.col("id").alias("src"))
    return out.join(stop, "src", "left_anti").distinct()


def taint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, question): the open questions that each node rests on, itself included. Searched backwards from the questions."""
    q = nodes.where("kind = 'question' and status = 'open'").select("id")
    back = depends(nodes, edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    far = reached_from(back, q.select(F.col("id").alias("start")))
    return q.select("id", F.col("id").alias("question")).union(far.select("id", F.col("start").alias("question"))).distinct()


def drifted_reach(edges: DataFrame, drifted: DataFrame, most: int = 8) -> DataFrame:
    """(source, id): what rests on ``drifted(start)`` sources over attests and derived_from edges, at most 8 steps away."""
    down = edges.where("type = 'attests'").select("src", "dst").union(edges.where("type = 'derived_from'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reached_from(down, drifted, most).select(F.col("start").alias("source"), "id")


def known_premises(edges: DataFrame) -> DataFrame:
    """(id, premises): what supports, causes or implies each node, sorted."""
    return edges.where(F.col("type").isin("supports", "causes", "implies")).groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("premises"))
