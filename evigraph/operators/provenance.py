"""Documents behind sources: paths, versions, relocation, backlog and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THIN = 2


def resolved_path(doc: Column, folder: Column) -> Column:
    """A document's path from the folder that declares it: dots are resolved; NULL for absolute, folder-like or escaping ones."""
    parts = F.filter(F.split(doc, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))).otherwise(F.concat(acc, F.array(p))))
    bad = doc.startswith("/") | doc.endswith("/") | F.exists(done, lambda p: p == "..")
    return F.when(~bad & (F.size(done) > 0), F.concat(folder, F.lit("/"), F.array_join(done, "/")))


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, hash) of ``files(path, length, content)``: SHA-256 over the bytes, without leaving the JVM."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def source_status(sources: DataFrame, locks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, state) of ``sources(id, path)``: outside-project, not-found, vanished, unrecorded, changed or ok."""
    rows = sources.join(locks.select("path", F.col("hash").alias("was")), "path", "left").join(files.select("path", F.col("hash").alias("now")), "path", "left")
    state = (
        F.when(F.col("path").isNull(), "outside-project").when(F.col("now").isNull() & F.col("was").isNotNull(), "vanished").when(F.col("now").isNull(), "not-found")
        .when(F.col("was").isNull(), "unrecorded").when(F.col("was") != F.col("now"), "changed").otherwise("ok")
    )
    return rows.select("id", "path", state.alias("state"))


def locked(locks: DataFrame, status: DataFrame, files: DataFrame, at: str, only: list[str] | None = None) -> DataFrame:
    """(path, hash, size, at): the locks after unrecorded and changed documents (of some ids) are accepted; vanished entries stay."""
    take = status.where("state in ('unrecorded', 'changed')")
    if only is not None:
        take = take.where(F.col("id").isin(*only))
    new = files.join(take.select("path").distinct(), "path", "left_semi").select("path", "hash", "size", F.lit(at).alias("at"))
    return locks.select("path", "hash", "size", "at").join(new.select("path"), "path", "left_anti").unionByName(new)


def relocated(status: DataFrame, locks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, old, new, candidates): vanished documents found elsewhere by their recorded hash; ``new`` only if the match is unique.

    Size and hash are one equi-join key; a size that no vanished document has drops a file before anything is compared.
    """
    gone = status.where("state = 'vanished'").join(locks.select("path", "hash", "size"), "path")
    found = gone.select("id", F.col("path").alias("old"), "hash", "size").join(files.select(F.col("path").alias("new"), "hash", "size"), ["hash", "size"])
    return found.groupBy("id", "old").agg(F.count("*").alias("candidates"), F.min("new").alias("new")).select("id", "old", F.when(F.col("candidates") == 1, F.col("new")).alias("new"), "candidates")


def backlog(docs: DataFrame, nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, state, facts, ready): each document and each source's one: missing, undocumented, unread, thin or read.

    ``docs(path)`` lists files and ``nodes.doc`` names them; ready says that there is text to read.
    """
    src = nodes.where("kind = 'source'").select(F.col("id").alias("src"), "doc")
    facts = edges.where("type = 'attests'").join(src, "src").groupBy("doc").agg(F.countDistinct("dst").alias("facts"))
    by_doc = src.groupBy("doc").agg(F.count("*").alias("sources")).join(facts, "doc", "left")
    rows = docs.select("path").distinct().withColumn("there", F.lit(True)).join(by_doc.where("doc is not null").withColumnRenamed("doc", "path"), "path", "full").join(texts.select("path", "readable"), "path", "left")
    n = F.coalesce("facts", F.lit(0))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("sources").isNull(), "unread").when(n < THIN, "thin").otherwise("read")
    lone = src.where("doc is null").select(F.col("src").alias("path"), F.lit("undocumented").alias("state"), F.lit(0).cast("long").alias("facts"), F.lit(False).alias("ready"))
    return rows.select("path", state.alias("state"), n.alias("facts"), F.coalesce("readable", F.lit(False)).alias("ready")).union(lone)


def brief(path: str, texts: DataFrame, nodes: DataFrame, edges: DataFrame, questions: int = 12) -> str:
    """What a reader of one document needs: its text, the facts it attests, and open questions."""
    text = texts.where(F.col("path") == path).select("text").first()
    src = nodes.where(F.col("doc") == path).select(F.col("id").alias("src"))
    facts = edges.where("type = 'attests'").join(src, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(nodes.select("id", "body"), "id").orderBy("id").collect()
    asks = nodes.where("kind = 'question' and status = 'open'").select("id", "body").orderBy("id").limit(questions).collect()
    lines = [f"# {path}", "", *(f"- {r['id']}: {r['body']}" for r in facts), "", "Open questions:", *(f"- {r['id']}: {r['body']}" for r in asks), "", (text["text"] if text else None) or "(no text)"]
    return "\n".join(lines)
