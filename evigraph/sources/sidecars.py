"""Files beside a log: verdicts, accepted findings, locks, high water, standing queries, named queries, documents and their texts."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.model import VERDICTS
from evigraph.operators.fold import latest

#: Old spellings of verdicts (fixed values).
OLD_VERDICTS = {"supported": "confirmed", "refuted": "unsupported"}
SKIPPED_FOLDERS = ("node_modules",)
TRANSCRIPT_SUFFIXES = (".ocr.md", ".txt", ".md")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")).where("trim(value) <> ''")
    return rows.select(F.from_json("value", schema).alias("r"), "pos").select("r.*", "pos")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The last verdict of each (fact, source); old spellings are read as the new ones."""
    rows = _lines(spark, path, "fact string, source string, verdict string, note string, by string, at string, machine boolean, excerpt string, excerpt_hash string, region struct<page:int,x:double,y:double,w:double,h:double>")
    said = F.col("verdict")
    for old, new in OLD_VERDICTS.items():
        said = F.when(F.col("verdict") == old, new).otherwise(said)
    rows = rows.withColumns({"verdict": said, "machine": F.coalesce("machine", F.lit(False))}).withColumnRenamed("by", "by_who")
    return latest(rows, "fact", "source")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """The last acceptance of each finding key."""
    rows = _lines(spark, path, "key string, check string, msg string, by string, at string, reason string, subject string, machine boolean")
    return latest(rows.withColumns({"machine": F.coalesce("machine", F.lit(False))}).withColumnRenamed("by", "by_who"), "key")


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """(dir, doc, hash, size, at): lines of ``path hash size [date]``; a path with blanks is quoted."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]*$", 1).alias("dir"), F.btrim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    p = r'^(?:"([^"]*)"|(\S+))\s+(\S+)\s+([0-9]+)(?:\s+(\S+))?$'
    part = lambda k: F.nullif(F.regexp_extract("v", p, k), F.lit(""))
    return rows.where(F.col("v").rlike(p)).select("dir", F.coalesce(part(1), part(2)).alias("doc"), part(3).alias("hash"), part(4).cast("long").alias("size"), part(5).alias("at"))


def read_high_water(path: str) -> dict:
    """{nodes, edges, at}; zeros without the file."""
    if not os.path.exists(path):
        return {"nodes": 0, "edges": 0, "at": ""}
    with open(path, encoding="utf-8") as f:
        return {"nodes": 0, "edges": 0, "at": "", **json.load(f)}


def raise_high_water(path: str, nodes: int, edges: int, at: str) -> bool:
    """Write the larger counts; whether anything rose."""
    was = read_high_water(path)
    if nodes <= was["nodes"] and edges <= was["edges"]:
        return False
    _replace(path, json.dumps({"nodes": max(nodes, was["nodes"]), "edges": max(edges, was["edges"]), "at": at}) + "\n")
    return True


def _replace(path: str, text: str) -> None:
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def append_verdict(path: str, verdict: dict) -> None:
    """Append one verdict; a machine's or an unsigned ``unsupported`` is refused."""
    v = {**verdict, "verdict": OLD_VERDICTS.get(verdict["verdict"], verdict["verdict"])}
    if v["verdict"] not in VERDICTS:
        raise ValueError(f"unknown verdict {v['verdict']!r}")
    if v["verdict"] == "unsupported" and (not v.get("by") or v.get("machine")):
        raise ValueError("only a signed person says unsupported")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(v, ensure_ascii=False) + "\n")


def append_acceptance(path: str, entry: dict) -> None:
    """Append one accepted finding; it must be signed."""
    if not entry.get("by"):
        raise ValueError("an acceptance is signed")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")


def read_standing(text: str) -> list[dict]:
    """Standing queries of a YAML list; unnamed, repeated and empty ones are errors."""
    import yaml

    rows = yaml.safe_load(text) or []
    names: set[str] = set()
    for r in rows:
        if not r.get("name") or not r.get("query"):
            raise ValueError(f"a standing query needs a name and a query: {r}")
        if r["name"] in names:
            raise ValueError(f"{r['name']!r} stands twice")
        names.add(r["name"])
    return rows


def write_standing(path: str, rows: list[dict]) -> None:
    """Write standing queries by name; none removes the file."""
    import yaml

    if rows:
        _replace(path, yaml.safe_dump(sorted(rows, key=lambda r: r["name"]), sort_keys=False, allow_unicode=True))
    elif os.path.exists(path):
        os.remove(path)


def write_projection(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the indexes in ``rows(idx, ...)`` in a table; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("idx").parquet(path)


def declared_sets(rows: list[dict]) -> dict[str, list[str]]:
    """Names by group; a query without one is a set of its own."""
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.get("group") or r["name"], []).append(r["name"])
    return out


def named_queries(markdown: str, fence: str = "queries") -> dict[str, str]:
    """``name: query`` lines inside fences of that tag."""
    out = {}
    for block in re.findall(rf"^```{re.escape(fence)}\s*\n(.*?)^```", markdown, re.S | re.M):
        for line in block.splitlines():
            name, sep, query = line.partition(":")
            if sep and name.strip() and not name.lstrip().startswith("#"):
                out[name.strip()] = query.strip()
    return out


def documents(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modified, content) below a folder; dot folders, ignored globs and the transcripts of listed documents are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    hidden = F.lit(False)
    for d in SKIPPED_FOLDERS:
        hidden = hidden | F.contains("path", F.lit(f"/{d}/"))
    rows = rows.where(~hidden & ~F.col("path").rlike(r"/\.[^/]+/"))
    for glob in ignore:
        rows = rows.where(~F.col("path").rlike("(^|/)" + re.escape(glob).replace(r"\*", "[^/]*") + "$"))
    pairs = transcripts(rows.select("path"))
    return rows.join(pairs.select(F.col("transcript").alias("path")), "path", "left_anti")


def transcripts(paths: DataFrame) -> DataFrame:
    """(doc, transcript): the sidecar text of each document, by the first suffix in order that is there."""
    kinds = F.array(*(F.struct(F.lit(k).alias("order"), F.concat("path", F.lit(s)).alias("transcript")) for k, s in enumerate(TRANSCRIPT_SUFFIXES)))
    wanted = paths.select(F.col("path").alias("doc"), F.explode(kinds).alias("t")).select("doc", "t.*")
    return wanted.join(paths.select(F.col("path").alias("transcript")), "transcript", "left_semi").groupBy("doc").agg(F.min_by("transcript", "order").alias("transcript"))


def texts(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, text, readable): a document's transcript, else its own bytes if they are UTF-8 text; NULL is unreadable."""
    pairs = transcripts(paths.select("path"))
    own = F.try_validate_utf8(F.col("content").cast("string"))
    side = paths.select(F.col("path").alias("transcript"), F.try_validate_utf8(F.col("content").cast("string")).alias("said"))
    rows = docs.join(pairs, docs.path == pairs.doc, "left").join(side, "transcript", "left")
    text = F.coalesce("said", own)
    return rows.select("path", text.alias("text"), text.isNotNull().alias("readable"))


def pages(docs: DataFrame) -> DataFrame:
    """(path, page, text): the parts of a text after each ``## Page N`` heading."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n## Page ")
    rows = docs.select("path", F.posexplode(parts).alias("k", "part")).where("k > 0")
    return rows.select("path", F.regexp_extract("part", "^([0-9]+)", 1).cast("int").alias("page"), F.regexp_replace("part", "^[0-9]+[^\n]*\n?", "").alias("text"))
