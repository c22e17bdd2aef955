"""Lookup by name: is a document or fact already there, by alias, source, path, sound, text or terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.sound import sound_alike
from evigraph.functions.text import LEAST_IDENTIFIER, content_terms, excerpt, identifier, identifier_forms, identifiers, snippet, term_hits
from evigraph.operators.graph import aliases

#: From the surest to the weakest (fixed values).
TIERS = ("alias", "source", "path", "sounds", "text", "terms")
MOST = 25


def _wanted(spark, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "q string").select("q", identifier_forms(F.col("q")).alias("forms"), content_terms(F.col("q"), identifiers(F.col("q"))).alias("terms"))


def have(nodes: DataFrame, texts: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """(tier, key, doc, hits, shown): the best tier of each thing that a name finds; at most ``most``, a report for people.

    The name is one row, which is joined as a constant: each table is scanned once.
    """
    want = _wanted(nodes.sparkSession, name).first()
    forms, terms = [x for x in want["forms"] if len(x) >= LEAST_IDENTIFIER], want["terms"]
    any_form = lambda c: F.exists(F.array(*map(F.lit, forms)), lambda f: F.contains(identifier(c), f)) if forms else F.lit(False)
    words = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    row = lambda tier, key, doc, hits, shown: (F.lit(tier).alias("tier"), key.alias("key"), doc.alias("doc"), hits.alias("hits"), shown.alias("shown"))
    one, none = F.lit(1), F.lit(None).cast("string")
    named = aliases(nodes).join(nodes.select("id", "doc"), "id")
    src = nodes.where("kind = 'source'")
    own = content_terms(F.col("body"))
    covered = (F.size(own) > 0) & (F.size(F.array_except(own, words)) == 0)
    d = texts.where("text is not null")
    place = F.greatest(F.expr("instr(lower(text), lower(q))"), F.lit(1))
    parts = [
        named.where(any_form(F.col("name"))).select(*row("alias", F.col("id"), F.col("doc"), one, F.col("name"))),
        src.where(any_form(F.coalesce("body", F.lit(""))) | any_form(F.coalesce("anchor", F.lit(""))) | covered).select(*row("source", F.col("id"), F.col("doc"), F.when(covered, F.size(own)).otherwise(1), excerpt(F.col("body")))),
        texts.where(any_form(F.col("path"))).select(*row("path", F.col("path"), F.col("path"), one, F.col("path"))),
        nodes.where("kind = 'entity'").where(sound_alike(F.col("body"), F.lit(name))).select(*row("sounds", F.col("id"), F.col("doc"), one, F.col("body"))),
        d.where(any_form(F.col("text"))).withColumn("q", F.lit(name)).select(*row("text", F.col("path"), F.col("path"), one, snippet(F.col("text"), place))),
        d.withColumn("h", term_hits(words, content_terms(F.col("text")))).where("h > 0").select(*row("terms", F.col("path"), F.col("path"), F.col("h"), none)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    best = out.withColumn("rank", rank).groupBy(F.coalesce("doc", "key").alias("thing")).agg(F.min_by(F.struct("tier", "key", "doc", "hits", "shown", "rank"), F.struct("rank", -F.col("hits"), "key")).alias("b"))
    return best.select("b.*").orderBy("rank", F.col("hits").desc(), "key").drop("rank").limit(most)


def possession(hits: DataFrame, texts: DataFrame, allow_text: bool = False) -> DataFrame:
    """The first hit whose document is there: never by terms, by text only if allowed."""
    tiers = [t for t in TIERS if t != "terms" and (allow_text or t != "text")]
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return hits.where(F.col("tier").isin(*tiers)).join(texts.select(F.col("path").alias("doc")), "doc", "left_semi").orderBy(rank, F.col("hits").desc(), "key").limit(1)


def already_held(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, identifier, path): open questions and actions that name an identifier of a document that is there; one equi-join."""
    asks = nodes.where("(kind = 'question' and status = 'open') or (kind = 'action' and status in ('open', 'proposed'))").select("id", F.explode(identifiers(F.col("body"))).alias("identifier"))
    held = texts.select("path", F.explode(F.array_distinct(F.concat(identifiers(F.col("path")), identifiers(F.coalesce("text", F.lit("")))))).alias("identifier"))
    return asks.join(held, "identifier").groupBy("id", "identifier").agg(F.min("path").alias("path"))


def search(texts: DataFrame, query: str, most: int = MOST) -> DataFrame:
    """(path, score): documents by BM25 over content terms: the local stand-in for a text index. Counts are partial sums; the query is a constant."""
    terms = _wanted(texts.sparkSession, query).first()["terms"]
    if not terms:
        return texts.select("path", F.lit(0.0).alias("score")).limit(0)
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")

    def times(term: str):
        return F.size(F.filter(words, lambda w: w == term))

    d = texts.where("text is not null").select("path", F.size(words).alias("n"), *(times(t).alias(f"t{k}") for k, t in enumerate(terms)))
    stats = d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col(f"t{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms)))).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        df = stats[f"df{k}"] or 0
        idf = F.log(F.lit(1 + ((stats["docs"] or 0) - df + 0.5) / (df + 0.5)))
        score = score + idf * F.col(f"t{k}") * 2.2 / (F.col(f"t{k}") + 1.2 * (0.25 + 0.75 * F.col("n") / F.lit(float(stats["mean"] or 1))))
    return d.select("path", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "path").limit(most)
