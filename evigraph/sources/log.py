"""Assertion logs: JSON lines, tables and JDBC in; append, export and import out."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.model import LOG, LOG_OPS

_LINE = "op string, id string, fields map<string,string>, reason string, into string, note string, by string, at string"


class LogError(ValueError):
    """A log says something malformed."""


def blank_to_null(c):
    """NULL for the empty string."""
    return F.when(c != "", c)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The assertions of JSON-lines files, with ``pos`` by file and line; blank lines and those that begin with // are skipped.

    A file of any size is read in splits. A line is numbered within its split, and splits by file name and place: tasks count their lines first, so
    only one row a split comes to the driver. Any malformed line raises LogError with its place when the result is checked by :func:`checked`.
    """
    split = [F.input_file_name().alias("file"), F.input_file_block_start().alias("block")]
    lines = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("m"), "value")
    # ids ascend within a split's task; a task may hold several small files
    parts = lines.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("*").alias("n")).collect()
    base, line, file, number = [], 0, None, -1
    for r in sorted(parts, key=lambda r: (r["file"], r["block"])):
        number, line = (number, line) if r["file"] == file else (number + 1, 0)
        file = r["file"]
        base.append((file, r["block"], number * (1 << 40) + line - r["first"], number * (1 << 40)))
        line += r["n"]
    places = spark.createDataFrame(base, "file string, block long, shift long, head long")
    lines = lines.where((F.btrim("value") != "") & ~F.ltrim("value").startswith("//"))
    a = F.from_json("value", _LINE, {"mode": "PERMISSIVE"})
    rows = lines.join(F.broadcast(places), ["file", "block"]).withColumn("a", a)
    cols = [blank_to_null(F.col(f"a.{k}")).alias(n) for k, n in (("op", "op"), ("id", "id"))]
    pos = F.col("m") + F.col("shift")
    return rows.select(
        *cols, F.col("a.fields").alias("fields"), blank_to_null(F.col("a.reason")).alias("reason"), blank_to_null(F.col("a.into")).alias("into_id"),
        blank_to_null(F.col("a.note")).alias("note"), blank_to_null(F.col("a.by")).alias("by_who"), blank_to_null(F.col("a.at")).alias("at"),
        pos.alias("pos"), "file", (pos - F.col("head") + 1).alias("line"),
    )


def faults(log: DataFrame) -> DataFrame:
    """The rows of a log that break its rules, with why."""
    why = (
        F.when(F.col("op").isNull() | ~F.col("op").isin(*LOG_OPS), "unknown op")
        .when(F.col("id").isNull(), "no id")
        .when(F.col("by_who").isNull(), "no signer")
        .when((F.col("op") == "assert") & F.col("fields").isNull(), "assert without fields")
        .when((F.col("op") == "withdraw") & F.col("reason").isNull(), "withdraw without a reason")
        .when((F.col("op") == "retire") & (F.col("into_id").isNull() | (F.col("into_id") == F.col("id"))), "retire needs another survivor")
    )
    return log.withColumn("why", why).where("why is not null")


def checked(log: DataFrame) -> DataFrame:
    """The log if it has no faults; LogError naming the first few otherwise."""
    bad = faults(log).limit(5).collect()
    if bad:
        at = lambda r: f"{r['file']}:{r['line']}" if "file" in r else f"position {r['pos']}"
        raise LogError("; ".join(f"{at(r)}: {r['why']}" for r in bad))
    return log.select(*[c.split()[0] for c in LOG.split(", ")])


def read_table(spark: SparkSession, path: str, idx: str) -> DataFrame:
    """The log of one index from a table partitioned by ``idx``: only its partition is read."""
    t = spark.read.parquet(path).where(F.col("idx") == idx)
    return t.select("op", "id", "fields", "reason", "into_id", "note", "by_who", "at", F.col("seq").alias("pos"))


def read_jdbc(spark: SparkSession, url: str, idx: str, table: str = "assertion", **options) -> DataFrame:
    """The log of one index from a database; the index is a pushed-down predicate and ``fields`` holds JSON text."""
    t = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col("idx") == idx)
    return t.select("op", "id", F.from_json("fields", "map<string,string>").alias("fields"), *(blank_to_null(F.col(c)).alias(c) for c in ("reason", "into_id", "note", "by_who", "at")), F.col("seq").cast("long").alias("pos"))


def read_sqlite(spark: SparkSession, path: str, idx: str, table: str = "assertion") -> DataFrame:
    """The same from a SQLite file, for single machines: rows stream through the driver in batches of a bounded size."""
    import sqlite3

    if not table.isidentifier():
        raise LogError(f"not a table name: {table!r}")
    con, out = sqlite3.connect(path), None
    try:
        cur = con.execute(f"select op, id, fields, reason, into_id, note, by_who, at, seq from {table} where idx = ? order by at, seq", (idx,))
        schema = LOG.replace("map<string,string>", "string")
        while rows := cur.fetchmany(50_000):
            part = spark.createDataFrame([tuple(x if x != "" else None for x in r) for r in rows], schema)
            out = part if out is None else out.union(part)
        out = out if out is not None else spark.createDataFrame([], schema)
    finally:
        con.close()
    return out.withColumn("fields", F.from_json("fields", "map<string,string>"))


def locate(dsn: str | None) -> tuple[str, str | None]:
    """(kind, place) of a store name: none, sqlite, jdbc or table."""
    if not dsn or dsn == "none":
        return "none", None
    if dsn.startswith("sqlite:"):
        return "sqlite", dsn.removeprefix("sqlite:")
    if dsn.startswith(("postgres://", "postgresql://")):
        return "jdbc", "jdbc:postgresql://" + dsn.split("://", 1)[1]
    return "table", dsn


def preferred(store: DataFrame | None, exports: DataFrame | None) -> DataFrame | None:
    """A store with any row wins; else the exported files."""
    return store if store is not None and not store.isEmpty() else exports


def append(log: DataFrame, path: str, idx: str) -> None:
    """Append assertions of one index to a table partitioned by ``idx``; there must be one writer for an index at a time.

    New rows are numbered after the largest ``seq`` by their (at, pos), with a range sort rather than one ordered task.
    """
    spark = log.sparkSession
    try:
        last = spark.read.parquet(path).where(F.col("idx") == idx).agg(F.max("seq")).first()[0] or 0
    except Exception as e:  # noqa: BLE001  the table doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    ordered = log.orderBy("at", "pos").select("*", F.monotonically_increasing_id().alias("place"))
    ordered.withColumns({"idx": F.lit(idx), "seq": F.col("place") + last + 1}).drop("place", "pos", "file", "line").write.mode("append").partitionBy("idx").parquet(path)


def export_jsonl(log: DataFrame, path: str) -> int:
    """Write a log as one JSON-lines file by a temporary name and a rename; lines that the file already has keep their bytes.

    Rows stream to the driver in order, one partition at a time; the export is a file for people, and no step of a query.
    """
    keep: list[str] = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            keep = [x for x in f.read().splitlines() if x.strip()]
    n, same = 0, True
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as out:
        for r in log.orderBy("at", "pos").toLocalIterator():
            line = said(r)
            same = same and n < len(keep) and json.loads(keep[n]) == line
            out.write((keep[n] if same else json.dumps(line, ensure_ascii=False)) + "\n")
            n += 1
        out.flush()
        os.fsync(out.fileno())
    os.replace(out.name, path)
    return n


def said(r) -> dict:
    """A row of a log as its line says it."""
    out = {"op": r["op"], "id": r["id"]}
    if r["fields"] is not None:
        out["fields"] = {k: _value(v) for k, v in sorted(r["fields"].items())}
    return out | {k: r[c] for k, c in (("reason", "reason"), ("into", "into_id"), ("note", "note"), ("by", "by_who"), ("at", "at")) if r[c] is not None}


def _value(text: str):
    if text is not None and text[:1] in "[{":
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text
