"""Rules and host reputation against plain Python and the registered SQL."""

import duckdb
import math
from pyspark.sql import types as T

from evigraph.llm import url_filter as uf
from evigraph.llm.queries import ORACLE_SQL, op9_url_filter

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])
MARKS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("bad", T.IntegerType())])


def test_parts_and_rules(spark):
    rows = [(1, "http://A.Example.COM/en/7x?q#f"), (2, "https://example.com/en/8"), (3, "https://www.org/es/"), (4, None), (5, "no scheme"), (6, "http://x.net?u=/de/"), (7, "http://example.net/de/81"), (8, "http://notcom/en/"), (9, "s://h/a://b/c#d"), (None, "http://É.com:80/en/")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "url as host", "page_id as bad")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(df, spark.createDataFrame([], MARKS)).collect()}
    assert got == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("example.com", "/en/8", "com/en/", "block"), 3: ("www.org", "/es/", "org/es/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("x.net", "", None, "allow"), 7: ("example.net", "/de/81", "example.net/de/8", "block"), 8: ("notcom", "/en/", None, "allow"), 9: ("h", "/a://b/c", None, "allow"), None: ("É.com:80", "/en/", None, "allow"),
    }


def test_reputation(spark):
    rows, marks = [], []
    for host, n, bad in (("bad.spam.example", 60, 58), ("other.spam.example", 3, 3), ("good.fine.example", 200, 4), ("new.fine.example", 1, 1), ("a.co.uk", 50, 0)):
        for k in range(n):
            rows.append((len(rows), f"http://{host}/fr/{k}"))
            marks.append((rows[-1][0], int(k < bad)))
    pages = spark.createDataFrame(rows, PAGES)
    got = {r["host"]: r["verdict"] for r in uf.judge(pages, spark.createDataFrame(marks + [(None, 1), (10**9, 1), (0, 7)], MARKS)).collect()}
    assert got == {"bad.spam.example": "block", "other.spam.example": "block", "good.fine.example": "allow", "new.fine.example": "allow", "a.co.uk": "allow"}
    seen = uf.levels(uf.parted(pages)).join(spark.createDataFrame(marks, MARKS), "page_id")
    for r in uf.reputation(seen).collect():
        t = r["a"] + r["b"]
        assert math.isclose(r["bound"], r["a"] / t - uf.Z * math.sqrt(r["a"] * r["b"] / (t * t * (t + 1))))


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], MARKS)).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op9_url_filter"]).fetchall()
    got = [tuple(r) for r in op9_url_filter(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_python_in_the_plan(spark):
    plan = op9_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
