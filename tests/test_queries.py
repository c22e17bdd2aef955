"""Every registered query with SQL against DuckDB on the small tables."""

import functools
import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph import catalog, catalog_more, catalog_sql

QUERIES = {**catalog.QUERIES, **catalog_more.QUERIES}
ORACLE_SQL = {**catalog_sql.ORACLE_SQL, **catalog_more.ORACLE_SQL}

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = plain(df.select(*(f"`{c}`" for c in cols)).collect())
    r = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == plain(tuple(x[names.index(c)] for c in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_near_misses_against_all_windows(spark):
    """The nearest window of each changed item, by a recursive common subsequence over every window of its text."""

    def words(text):
        return re.findall("[a-z0-9]+", text.lower())

    def common(a, b):
        @functools.cache
        def of(i, j):
            if i == len(a) or j == len(b):
                return 0
            return 1 + of(i + 1, j + 1) if a[i] == b[j] else max(of(i + 1, j), of(i, j + 1))

        return of(0, 0)

    items = {i: t for i, t in duckdb.execute(f"select item_id, text from '{D}/benchmark.parquet'").fetchall() if t.isascii() and len(words(t)) < 60}
    got = {r["item_id"]: r for r in QUERIES["q_near_miss"](spark, D).collect()}
    seen = 0
    for item, t in items.items():
        quote, whole = words(re.sub(r"^(\S+\s+\S+)\s+\S+", r"\1 replaced", t)), words(t)
        scored = [(2 * common(quote, whole[k : k + len(quote)]) / (len(quote) + len(whole[k : k + len(quote)])), " ".join(whole[k : k + len(quote)])) for k in range(len(whole))]
        best = max(x for x, _ in scored)
        if best >= 0.75:
            assert got[item]["ratio"] == round(best, 6) and got[item]["passage"] in [p for x, p in scored if x == best]
            seen += 1
        else:
            assert got[item]["passage"] is None
    assert seen > 0


def test_satisfied_while_by_recursion(spark):
    """Each order and group judged alone along its own path, where a node met again is false."""
    orders = {f"o-{k}": (f"g-{c}", s) for k, c, s in duckdb.execute(f"select o_orderkey, o_custkey, o_orderstatus from '{D}/orders.parquet'").fetchall()}
    members = {}
    for o, (g, _) in orders.items():
        members.setdefault(g, []).append(o)

    def holds(x, path=()):
        if x in path:
            return False
        if x in orders:
            group, status = orders[x]
            return status in "OF" and (x[-1] != "7" or holds(group, (*path, x)))
        n, ok = len(members[x]), sum(holds(m, (*path, x)) for m in members[x])
        return [ok == n, ok >= 1, ok == 0, ok >= 2, ok < 3, ok == 1, n > 0][int(x[2:]) % 7]

    want = {k: sum(map(holds, xs)) for k, xs in (("o", orders), ("g", members))}
    assert {r["kind"]: r["n"] for r in QUERIES["q_satisfied_while"](spark, D).collect()} == {k: n for k, n in want.items() if n}


def test_long_cycles(spark):
    """A cycle longer than Python's stack, with a node outside that waits for it."""
    from evigraph.catalog import edge, node
    from evigraph.operators import derive

    n = 1500
    ring = spark.range(n + 1).withColumn("to", F.when(F.col("id") < n, (F.col("id") + 1) % n).otherwise(0))
    nodes = node(ring, id=F.concat(F.lit("n"), "id"), kind=F.lit("claim"), status=F.lit("asserted"), **{"while": F.concat(F.lit("n"), "to")})
    got = derive.satisfied(nodes, edge(ring.where("false"), F.lit(""), "member_of", F.lit(""))).collect()
    assert len(got) == n + 1 and not any(r["ok"] for r in got)


def test_gates_that_wait_for_themselves(spark):
    """A group whose member's gate is the group itself: the gate is false, so the group has no live member."""
    from evigraph.catalog import edge, node
    from evigraph.operators import derive

    one = spark.range(1)
    nodes = node(one, id=F.lit("m"), kind=F.lit("claim"), status=F.lit("asserted")).unionByName(node(one, id=F.lit("g"), kind=F.lit("group"), group_expr=F.lit("all")))
    edges = edge(one, F.lit("m"), "member_of", F.lit("g"), **{"while": F.lit("g")})
    assert {r["id"]: r["ok"] for r in derive.satisfied(nodes, edges, "2024-01-01").collect()} == {"m": True, "g": False}


def test_near_dupes_of_all_languages(spark, tmp_path):
    words = lambda k: [f"word{k}x{j}" for j in range(20)]
    langs = [("en", "en"), ("de", "en"), (None, "en"), ("fr", "fr"), (None, None)]
    docs = []
    for k, (a, b) in enumerate(langs):
        docs += [(2 * k, " ".join(words(k)), a), (2 * k + 1, " ".join([*words(k)[:-1], f"end{k}"]), b)]
    docs += [(99, "nothing like the others", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {f"d-{d}": set(t.split()) for d, t, _ in docs}
    score = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r["a"], r["b"]): r["score"] for r in QUERIES["q_near_dupes"](spark, str(tmp_path)).collect()}
    assert got == {k: round(x, 6) for k, x in score.items() if x >= 0.72} and len(got) == len(langs)


def test_alias_conflicts_of_all_names(spark):
    larger = "/root/testdata/sf0.01"  # with customers of 300 and more
    got = {r["name"]: (r["n"], r["overlaps"]) for r in QUERIES["q_alias_conflicts"](spark, larger).collect()}
    by = {}
    for c, k, a, b in duckdb.execute(f"select o_custkey, 'o-' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate::date + 200, '%Y-%m-%d') from '{larger}/orders.parquet'").fetchall():
        by.setdefault(f"name {c}", []).append((a, b, k))
    want = {}
    for name, rows in by.items():
        rows.sort()
        if len(rows) > 1:
            want[name] = (len(rows) - 1, sum(rows[k][0] < max(r[1] for r in rows[:k]) for k in range(1, len(rows))))
    assert got == want and any(int(x.split()[1]) >= 300 for x in got)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "kind", "body"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
