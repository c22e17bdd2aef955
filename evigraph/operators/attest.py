"""Human attestation: verdicts, what waits for one, in which order, and what lost all support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.checks import subtracting

#: What comes first in the queue (fixed values, by order).
BANDS = ("disputed", "impeached", "pinned", "sole citation", "other", "inference")


def stands(verdict: Column, by: Column, machine: Column) -> Column:
    """Whether an attestation with this verdict still supports: only a signed person's unsupported takes it away."""
    return ~F.coalesce((verdict == "unsupported") & by.isNotNull() & ~machine, F.lit(False))


def by_people(verdicts: DataFrame) -> DataFrame:
    """The verdicts of signed persons."""
    return verdicts.where("by_who is not null and not machine")


def pending(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(fact, source): attestations without a person's verdict, of facts that aren't withdrawn."""
    gone = nodes.where("status in ('withdrawn', 'false')").select(F.col("id").alias("fact"))
    cites = edges.where("type = 'attests'").select(F.col("dst").alias("fact"), F.col("src").alias("source")).distinct()
    return cites.join(gone, "fact", "left_anti").join(by_people(verdicts).select("fact", "source"), ["fact", "source"], "left_anti")


def ranked(waiting: DataFrame, nodes: DataFrame, edges: DataFrame, tension: DataFrame, pinned: DataFrame) -> DataFrame:
    """``waiting(fact, source)`` with its band: tension first, then pinned facts, then those with one citation."""
    cites = edges.where("type = 'attests'").groupBy(F.col("dst").alias("fact")).agg(F.count("*").alias("cites"))
    rows = waiting.join(tension.select(F.col("id").alias("fact"), "tension"), "fact", "left").join(pinned.select(F.col("id").alias("fact")).distinct().withColumn("pinned", F.lit(True)), "fact", "left")
    rows = rows.join(cites, "fact", "left").join(nodes.select(F.col("id").alias("source"), "form"), "source", "left")
    band = F.when(F.col("tension") == "disputed", 0).when(F.col("tension") == "impeached", 1).when(F.col("form") == "inference", 5).when(F.coalesce("pinned", F.lit(False)), 2).when(F.col("cites") == 1, 3).otherwise(4)
    return rows.select(band.alias("band"), "fact", "source", "cites")


def miscited(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame, pinned: DataFrame) -> DataFrame:
    """(fact): pinned facts that had citations of which none stands any more."""
    cites = edges.where("type = 'attests'").select(F.col("dst").alias("fact"), F.col("src").alias("source"))
    gone = subtracting(verdicts).select("fact", "source", F.lit(True).alias("gone"))
    rows = cites.join(gone, ["fact", "source"], "left").groupBy("fact").agg(F.bool_or(F.col("gone").isNull()).alias("left"))
    live = nodes.where("coalesce(status, '') not in ('withdrawn', 'false')").select(F.col("id").alias("fact"))
    return rows.where("not left").select("fact").join(pinned.select(F.col("id").alias("fact")), "fact", "left_semi").join(live, "fact", "left_semi")


def report(verdicts: DataFrame) -> DataFrame:
    """(verdict, n, last_by, last_at): how often each was given, and the last signer."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.max_by("by_who", "at").alias("last_by"), F.max("at").alias("last_at"))


def page_hints(terms: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """(id, path, page, score): for ``terms(id, path, terms)`` the pages of its document whose words fit best, rarer words counting more."""
    from pyspark.sql import Window

    from evigraph.functions.text import content_terms

    words = pages.select("path", "page", F.explode(content_terms(F.col("text"))).alias("term"))
    df = words.groupBy("path", "term").agg(F.count("*").alias("df"))
    rows = terms.select("id", "path", F.explode("terms").alias("term")).join(words, ["path", "term"]).join(df, ["path", "term"]).groupBy("id", "path", "page").agg(F.sum(1 / F.col("df")).alias("score"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "path").orderBy(F.col("score").desc(), "page"))).where(F.col("r") <= most).drop("r")


def workbench(waiting: DataFrame, used: DataFrame) -> DataFrame:
    """(source, facts, uses): what waits by source, those first whose facts more declared queries use."""
    rows = waiting.join(used.select(F.col("id").alias("fact"), F.size("names").alias("uses")), "fact", "left")
    return rows.groupBy("source").agg(F.sort_array(F.collect_set("fact")).alias("facts"), F.sum(F.coalesce("uses", F.lit(0))).alias("uses"))
