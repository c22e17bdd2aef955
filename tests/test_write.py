"""Checked writes, aliases, moved documents, logs read in splits, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph import cli
from evigraph.operators import fold, write
from evigraph.plans.compile import load
from evigraph.sources import log as logs

LINES = [
    {"op": "assert", "id": "s1", "fields": {"document": "a report", "class": "record", "doc": "a.txt", "attests": "c1"}, "by": "me", "at": "2024-01-01"},
    {"op": "assert", "id": "c1", "fields": {"claim": "it rained", "status": "asserted", "value": "3"}, "by": "me", "at": "2024-01-01"},
    {"op": "assert", "id": "e1", "fields": {"entity": "the town", "aliases": ["Town"]}, "by": "me", "at": "2024-01-02"},
    {"op": "assert", "id": "e2", "fields": {"entity": "the lake"}, "by": "me", "at": "2024-01-02"},
    {"op": "assert", "id": "c2", "fields": {"claim": "the lake rose", "status": "asserted", "about": "e2", "value": "7"}, "by": "me", "at": "2024-01-03"},
]


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "facts.jsonl"
    p.write_text("// a log\n" + "\n".join(json.dumps(x) for x in LINES) + "\n\n")
    return str(p)


def test_apply_is_all_or_nothing(spark, path):
    log = logs.checked(logs.read_jsonl(spark, path))
    assert [r["id"] for r in log.orderBy("pos").collect()] == [x["id"] for x in LINES]
    kept = []
    good = fold.asserting(spark, "c3", {"claim": "a third", "status": "asserted", "about": "e1"}, "me", "2024-02-01")
    write.apply(log, good, lambda rows: kept.append(rows.count()))
    assert kept == [1]
    for bad, why in (
        (fold.asserting(spark, "c4", {"claim": "x", "about": "nobody"}, "me", "2024-02-01"), "names no node"),
        (fold.asserting(spark, "c4", {"claim": "x"}, None, "2024-02-01"), "no signer"),
        (fold.retiring(spark, "c1", "e1", "me", "2024-02-01"), "retired"),
        (good.unionByName(fold.asserting(spark, "c5", {"claim": "x", "status": "what"}, "me", "2024-02-01")), "unknown status"),
    ):
        with pytest.raises(write.Refused, match=why):
            write.apply(log, bad, lambda rows: kept.append(rows.count()))
    assert kept == [1]
    assert write.apply(log, good.limit(0), kept.append).count() == 0 and kept == [1]


def test_aliases_and_moves(spark, path):
    log = logs.checked(logs.read_jsonl(spark, path))
    nodes = load(log).nodes
    rows = write.adding_alias(log, nodes, "e1", "Old Town", "me", "2024-03-01")
    assert json.loads(rows.first()["fields"]["aliases"]) == ["Town", {"as": "Old Town"}]
    for target, name, why in (("no", "x", "no node"), ("e1", " ", "empty"), ("e1", "town!", "already"), ("e2", "Town", "denotes 'e1'")):
        with pytest.raises(write.Refused, match=why):
            write.adding_alias(log, nodes, target, name, "me", "2024-03-01")
    moved = spark.createDataFrame([("s1", "a.txt", "b/a.txt"), ("s2", "x", None)], "id string, old string, new string")
    new = write.relocating(log, moved, "me", "2024-03-01").collect()
    assert [(r["id"], r["fields"]["doc"], r["fields"]["document"]) for r in new] == [("s1", "b/a.txt", "a report")]
    both = write.imported(log, log)
    assert both.count() == 2 * log.count() and both.select("pos").distinct().count() == both.count()
    idx = log.withColumn("idx", F.when(F.col("id").startswith("c"), "claims").otherwise("rest"))
    assert {(r["idx"], r["assertions"]) for r in write.indexes(idx).collect()} == {("claims", 2), ("rest", 3)}


def test_logs_are_read_in_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"op": "assert", "id": f"n{k}-{j}", "fields": {"entity": "x" * 50}, "by": "me"}) + "\n" for j in range(400)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = logs.read_jsonl(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        got = [(r["id"], r["line"]) for r in rows.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [(f"n{k}-{j}", j + 1) for k in range(3) for j in range(400)]


def test_command_line(spark, path, tmp_path, capsys):
    run = lambda *x: (cli.main([x[0], path, *x[1:]]), capsys.readouterr())
    assert run("query", "claim sort value desc")[1].out.splitlines() == ["c2\tclaim\tthe lake rose", "c1\tclaim\tit rained"]
    assert run("query", "claim[")[0] == 2
    assert run("assert", "c9", "claim=it snowed", "about=e1", "--by", "me", "--at", "2024-05-01")[0] == 0
    assert run("withdraw", "c1", "untrue", "--by", "me", "--at", "2024-05-02")[0] == 0
    assert [x.split("\t")[0] for x in run("query", "claim[status=withdrawn]")[1].out.splitlines()] == ["c1"]
    assert run("alias", "e2", "Lake", "--by", "me", "--at", "2024-05-03")[0] == 0
    assert [x.split("\t")[0] for x in run("query", 'claim -about-> #"Lake"')[1].out.splitlines()] == ["c2"]
    lines = [json.loads(x) for x in open(path).read().splitlines() if x.startswith("{")]
    assert len(lines) == len(LINES) + 3 and lines[-1]["id"] == "e2"
