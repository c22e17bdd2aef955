"""Reachability and connected components as loops of joins over written tables; no pairs where a set is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.sources.shared import unsized, written


def reaching(edges: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(id): everything from which one of ``targets(id)`` is reached over ``edges(src, dst)`` in one step or more.

    Semi-naive backward search over sets: each round joins only the last frontier and drops what was seen, so its work is bounded by
    the edges and not by pairs. A target is in the result only if a path leads back to it.
    """
    edges = edges.select("src", "dst").distinct()
    frontier = written(_before(edges, targets), "reach")
    seen, k = frontier, 1
    while not frontier.isEmpty() and (most is None or k < most):
        frontier = written(_before(edges, frontier).join(unsized(seen), "id", "left_anti"), "reach")
        seen = seen.union(frontier)
        k += 1
    return seen


def _before(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(unsized(ids).withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def reached_from(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, id): the nodes that each of ``starts(start)`` reaches in one step or more. Keep the starts few: rows are pairs."""
    edges = edges.select("src", "dst").distinct()
    step = lambda f: f.join(edges, f.id == edges.src).select("start", F.col("dst").alias("id")).distinct()
    frontier = written(step(starts.select("start", F.col("start").alias("id"))), "reached")
    seen, k = frontier, 1
    while not frontier.isEmpty() and (most is None or k < most):
        frontier = written(step(frontier).join(seen, ["start", "id"], "left_anti"), "reached")
        seen = seen.union(frontier)
        k += 1
    return seen


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of ``links(a, b)`` is connected with, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    lone = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = lone.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
    return found.select("id", F.coalesce("component", "id").alias("component"))


def neighbourhood(edges: DataFrame, centre: str, depth: int, limit: int = 250) -> tuple[DataFrame, DataFrame, bool]:
    """(ids, edges among them, whether the limit cut it): the undirected surroundings of a node; nearer nodes first, then by id."""
    spark = edges.sparkSession
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("dst", "src"))
    seen = spark.createDataFrame([(centre, 0)], "id string, depth int")
    frontier = seen
    for k in range(1, depth + 1):
        near = both.join(frontier.select(F.col("id").alias("x")), "x", "left_semi").select(F.col("y").alias("id")).distinct()
        frontier = written(near.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)).orderBy("id").limit(limit + 1), "near")
        seen = seen.union(frontier)
    kept = written(seen.orderBy("depth", "id").limit(limit), "near")
    cut = seen.limit(limit + 1).count() > limit
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inside.dropDuplicates(["src", "dst", "type"]), cut
