"""Duplicate facts: exact by content id, near by rare tokens and overlap, and their clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.text import normalized, tokens
from evigraph.operators.closure import components

NEAR = 0.72
RARE_TOKENS, REPORTED = 3, 25


def exact(nodes: DataFrame) -> DataFrame:
    """(kind, norm, ids): bodies of one kind that are equal after normalization; ids sorted."""
    rows = nodes.where("body is not null").select("id", "kind", normalized(F.col("body")).alias("norm"))
    # the text itself is grouped by its hash, so that keys stay short
    g = rows.groupBy("kind", F.sha2("norm", 256).alias("h")).agg(F.first("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    return g.where("n > 1").select("kind", "norm", "ids")


def rare_tokens(nodes: DataFrame, count: int = RARE_TOKENS) -> DataFrame:
    """(id, kind, size, token): each node's rarest tokens within its kind, by document frequency and then by the token."""
    t = nodes.where("body is not null").select("id", "kind", F.explode(tokens(F.col("body"))).alias("token"))
    df = t.groupBy("kind", "token").agg(F.count("*").alias("df"))
    ranked = t.join(df, ["kind", "token"]).groupBy("id", "kind").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "token"))), 1, count).alias("r"), F.count("*").alias("size"))
    return ranked.select("id", "kind", "size", F.explode("r.token").alias("token"))


def near(nodes: DataFrame, edges: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(a, b, score): pairs of one kind with a token overlap of at least the threshold that no edge connects; a < b.

    Nodes meet under their rarest tokens. Equal bodies are reported by :func:`exact` and take part here once, by their least id, so a
    large group of copies makes no pairs; and a bucket's pairs are formed by sizes that can reach the threshold only. No bucket is
    skipped and no work budget cuts the search.
    """
    first = nodes.where("body is not null").groupBy("kind", F.sha2(normalized(F.col("body")), 256).alias("h")).agg(F.min_by(F.struct("id", "body"), "id").alias("n")).select("kind", "n.*")
    r = rare_tokens(first)
    sized = r.withColumn("cell", F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold))).cast("int"))
    # sizes within the threshold lie in the same or the next cell of the logarithm
    other = sized.select(F.col("id").alias("b"), "kind", "token", F.col("size").alias("size_b"), F.col("cell").alias("cell_b"))
    mine = sized.select(F.col("id").alias("a"), "kind", "token", F.col("size").alias("size_a"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b"))
    pairs = mine.join(other, ["kind", "token", "cell_b"]).where(fits).select("a", "b").distinct()
    toks = first.select("id", tokens(F.col("body")).alias("t"))
    scored = pairs.join(toks.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(toks.withColumnsRenamed({"id": "b", "t": "tb"}), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    scored = scored.select("a", "b", (both / (F.size("ta") + F.size("tb") - both)).alias("score")).where(F.col("score") >= threshold)
    related = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return scored.join(related, ["a", "b"], "left_anti")


def best_matches(pairs: DataFrame) -> DataFrame:
    """(id, other, score): each node's best partner; ties go to the lesser id."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(pairs.select("b", "a", "score"))
    return both.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("m")).select("id", "m.other", (-F.col("m.less")).alias("score"))


def report(pairs: DataFrame, most: int = REPORTED) -> tuple[DataFrame, int]:
    """The first pairs by score for people, and how many more there are."""
    return pairs.orderBy(F.col("score").desc(), "a", "b").limit(most), max(0, pairs.count() - most)


def same_file(nodes: DataFrame) -> DataFrame:
    """(doc, ids): documents that several sources stand on, unless all have anchors and these differ."""
    g = nodes.where("kind = 'source' and doc is not null").groupBy("doc").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"), F.count("anchor").alias("anchored"), F.countDistinct("anchor").alias("distinct_anchors")
    )
    return g.where((F.col("n") > 1) & ~((F.col("anchored") == F.col("n")) & (F.col("distinct_anchors") == F.col("n")))).select("doc", "ids")


def clusters(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, ids, same_file, cites, keep): connected duplicates; the most cited member is to be kept, ties by id."""
    shared = same_file(nodes).select(F.element_at("ids", 1).alias("a"), F.explode("ids").alias("b")).where("a <> b")
    comp = components(pairs.select("a", "b").union(shared))
    cites = edges.where("type = 'attests'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c"))
    rows = comp.join(cites, "id", "left").join(nodes.select("id", "doc"), "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return rows.groupBy(F.col("component").alias("cluster")).agg(
        F.sort_array(F.collect_list("id")).alias("ids"), ((F.countDistinct("doc") == 1) & (F.count("doc") == F.count("*"))).alias("same_file"), F.sum("c").alias("cites"), F.min_by("id", F.struct(-F.col("c"), "id")).alias("keep")
    )


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their place in a short report."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
