"""The command line over a JSON-lines log.

    python -m evigraph.cli query facts.jsonl 'claim[disputed] sort id' [--now DATE] [--dialect NAME] [--json]

Reads: query QUERY, scan, status STANDING, ask STANDING, diff STANDING, variants STANDING, profile, export FILE, have NAME DOCS, quotes DOCS,
queue [VERDICTS], sources LOCKS DOCS, relocate LOCKS DOCS, dupes. Writes, each checked before it is appended: assert ID KEY=VALUE...,
withdraw ID REASON, retire ID INTO, correct OLD REASON NEW KEY=VALUE..., answer QUESTION ID KEY=VALUE..., amend ID KEY=VALUE... (KEY= drops a
key), alias ID NAME, import LOG, accept STANDING (records the answers as they are now).
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import attest, checks, dedupe, fold, have, pins, provenance, quotes, write
from evigraph.operators import graph as assembly
from evigraph.plans.compile import load
from evigraph.plans.query import QueryError
from evigraph.sources import dialect, log, sidecars

WRITES = ("assert", "withdraw", "retire", "correct", "answer", "amend", "alias", "import")
READS = ("query", "scan", "status", "ask", "diff", "variants", "accept", "profile", "export", "have", "quotes", "queue", "sources", "relocate", "dupes")


def _pairs(items: list[str]) -> dict[str, str | None]:
    """KEY=VALUE arguments; an empty value is None."""
    wrong = [x for x in items if "=" not in x]
    if wrong:
        raise ValueError(f"not KEY=VALUE: {', '.join(wrong)}")
    return {k: v or None for k, _, v in (x.partition("=") for x in items)}


def _appender(path: str):
    """Appends rows to a JSON-lines file: what a person writes at once, a few lines."""

    def put(rows: DataFrame) -> None:
        with open(path, "a", encoding="utf-8") as f:
            for r in rows.orderBy("at", "pos").collect():
                f.write(json.dumps(log.said(r), ensure_ascii=False) + "\n")

    return put


def _new_rows(spark: SparkSession, a, lines: DataFrame, words: dialect.Dialect) -> DataFrame:
    at = a.at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    r, by = a.rest, a.by
    fields = lambda k: {x: v for x, v in _pairs(r[k:]).items() if v is not None}
    if a.command == "assert":
        return fold.asserting(spark, r[0], fields(1), by, at)
    if a.command == "withdraw":
        return fold.withdrawing(spark, r[0], r[1], by, at)
    if a.command == "retire":
        return fold.retiring(spark, r[0], r[1], by, at)
    if a.command == "correct":
        return fold.correcting(spark, r[0], r[1], r[2], fields(3), by, at)
    if a.command == "answer":
        return fold.answering(lines, r[0], r[1], fields(2), by, at)
    if a.command == "amend":
        return fold.amending(lines, r[0], _pairs(r[1:]), by, at)
    if a.command == "alias":
        return write.adding_alias(lines, load(lines, words).nodes, r[0], r[1], by, at)
    return log.checked(log.read_jsonl(spark, r[0]))


def _documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(texts(path, text), files(path, size, hash)) of the documents below a folder, by their paths from it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.substring_index("path", root.rstrip("/") + "/", -1)
    raw = raw.withColumn("path", place)
    return raw.select("path", F.decode("content", "UTF-8").alias("text")), provenance.fingerprints(raw)


def main(args: list[str] | None = None) -> int:
    """Run one command; 1 if a scan finds errors or an answer is stale, 2 for a query or a write that is refused."""
    p = argparse.ArgumentParser(prog="evigraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=READS + WRITES)
    p.add_argument("log")
    p.add_argument("rest", nargs="*")
    p.add_argument("--now")
    p.add_argument("--dialect")
    p.add_argument("--by", default="")
    p.add_argument("--at")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("evigraph").getOrCreate()
    words = dialect.resolve(a.dialect)
    lines = log.checked(log.read_jsonl(spark, a.log))
    try:
        if a.command in WRITES:
            warnings = write.apply(lines, _new_rows(spark, a, lines, words), _appender(a.log), words)
            return _show(warnings, a.json)
        return _read(spark, a, lines, words)
    except (QueryError, write.Refused, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


def _show(rows: DataFrame, as_json: bool) -> int:
    found = [r.asDict() for r in rows.collect()]
    if as_json:
        print(json.dumps(found, ensure_ascii=False))
    else:
        for r in found:
            print(*(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else v for v in r.values()), sep="\t")
    return 0


def _read(spark: SparkSession, a, lines: DataFrame, words: dialect.Dialect) -> int:
    if a.command == "export":
        print(log.export_jsonl(lines, a.rest[0]))
        return 0
    g = load(lines, words, a.now)
    if a.command == "query":
        return _show(g.rows(a.rest[0]), a.json)
    if a.command == "profile":
        return _show(assembly.profile(g.nodes, g.edges).orderBy("measure", "item"), a.json)
    if a.command == "scan":
        found = checks.run(g).orderBy("severity", "check").cache()
        _show(found, a.json)
        return int(not found.where("severity = 'error'").isEmpty())
    if a.command == "dupes":
        return _show(dedupe.clusters(g.nodes, g.edges, dedupe.near(g.nodes, g.edges)), a.json)
    if a.command == "queue":
        said = sidecars.read_verdicts(spark, a.rest[0]) if a.rest else spark.createDataFrame([], "fact string, source string, verdict string, by_who string, machine boolean")
        none = g.nodes.select("id").limit(0)
        return _show(attest.ranked(attest.pending(g.nodes, g.edges, said), g.nodes, g.edges, g.tension(g.now), none).orderBy("band", "fact", "source"), a.json)
    if a.command == "have":
        return _show(have.have(g.nodes, _documents(spark, a.rest[1])[0], a.rest[0]), a.json)
    if a.command == "quotes":
        return _show(quotes.checked(g.nodes, g.edges, _documents(spark, a.rest[0])[0]).orderBy("id", "doc"), a.json)
    if a.command in ("sources", "relocate"):
        locks, (_, files) = sidecars.read_locks(spark, a.rest[0]), _documents(spark, a.rest[1])
        state = provenance.source_status(g.nodes.where("kind = 'source' and doc is not null").select("id", F.col("doc").alias("path")), locks, files)
        if a.command == "sources":
            return _show(state.orderBy("id"), a.json)
        moved = provenance.relocated(state, locks, files)
        if a.apply:
            at = a.at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            write.apply(lines, write.relocating(lines, moved, a.by, at), _appender(a.log), words)
        return _show(moved.orderBy("id"), a.json)
    return _standing(g, a)


def _standing(g, a) -> int:
    """Commands on recorded answers."""
    with open(a.rest[0], encoding="utf-8") as f:
        standing = sidecars.read_standing(f.read())
    if a.command == "accept":
        only = set(a.rest[1:])
        rows = [{**s, "pin": pins.pin(g, s["query"]), "query_hash": pins.query_hash(s["query"])} if not only or s["name"] in only else s for s in standing]
        sidecars.write_standing(a.rest[0], rows)
        return 0
    if a.command == "variants":
        return _show(pins.variants(g, {s["name"]: s["query"] for s in standing}), a.json)
    if a.command == "diff":
        for s in standing:
            print(*pins.statements(s["name"], pins.difference(s.get("pin"), pins.pin(g, s["query"]))), sep="\n")
        return 0
    states = {s["name"]: pins.drift(g, s["query"], s.get("pin"), recorded_query=s.get("query_hash")) for s in standing}
    for name, state in states.items():
        print(name, ", ".join(state), sep="\t")
    return int(any(s != ["fresh"] for s in states.values()))


if __name__ == "__main__":
    sys.exit(main())
