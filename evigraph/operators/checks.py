"""Integrity checks. Each returns (check, severity, subjects, message) rows; :func:`run` is their union, levelled by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators import dedupe
from evigraph.operators.graph import alias_conflicts, repeated
from evigraph.plans.compile import Graph

MOST_BODY = 240
BROAD, BROAD_WITH_PURPOSE, LEAST_POPULATION = 75, 90, 20


def found(rows: DataFrame, check: str, severity: str, subjects: Column, message: Column | str) -> DataFrame:
    """Rows as findings."""
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subjects.alias("subjects"), said.alias("message"))


def _one(c: str = "id") -> Column:
    return F.array(F.col(c))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References to nodes that don't exist: edge ends and gates, while, owner, speaker and premises."""
    refs = edges.select(F.col("src").alias("id"), F.explode(F.array(*(F.struct(F.lit(k).alias("where"), F.col(f"`{k}`").alias("ref")) for k in ("src", "dst", "while")))).alias("r")).select("id", "r.*")
    own = nodes.select("id", F.explode(F.concat(F.array(*(F.struct(F.lit(k).alias("where"), F.col(f"`{k}`").alias("ref")) for k in ("while", "owner", "speaker"))), F.transform(F.coalesce("premises", F.array().cast("array<string>")), lambda p: F.struct(F.lit("premises").alias("where"), p.alias("ref"))))).alias("r")).select("id", "r.*")
    refs = refs.union(own).where("ref is not null").distinct().join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti")
    return found(refs, "dangling", "error", F.array("id", "ref"), F.concat(F.col("where"), F.lit(" names no node: "), F.col("ref")))


def duplicate_ids(nodes_raw: DataFrame) -> DataFrame:
    """Ids declared more than once."""
    return found(repeated(nodes_raw, "id"), "duplicate-id", "error", _one(), F.concat(F.lit("declared "), F.col("times").cast("string"), F.lit(" times")))


def repeated_edges(edges_raw: DataFrame) -> DataFrame:
    """Relations stated more than once."""
    rows = repeated(edges_raw, "src", "dst", "type", "valid_from", "valid_until", "while")
    return found(rows, "repeated-edge", "warn", F.array("src", "dst"), F.concat(F.col("type"), F.lit(" is stated "), F.col("times").cast("string"), F.lit(" times")))


def alias_clashes(names: DataFrame) -> DataFrame:
    """Names that denote two nodes; an error where both do at one time."""
    rows = alias_conflicts(names)
    sev = F.when(F.col("overlap"), "error").otherwise("warn")
    return rows.select(F.lit("alias").alias("check"), sev.alias("severity"), F.array("a", "b").alias("subjects"), F.concat(F.lit("both are called "), F.col("name")).alias("message"))


def anchor_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An entity is about nothing; an event is about an entity."""
    k = nodes.select("id", "kind")
    rows = edges.where("type = 'about'").select("src", "dst").join(k.withColumnsRenamed({"id": "src", "kind": "k1"}), "src").join(k.withColumnsRenamed({"id": "dst", "kind": "k2"}), "dst")
    a = found(rows.where("k1 = 'entity'"), "anchor", "error", F.array("src", "dst"), "an entity is about nothing")
    return a.union(found(rows.where("k1 = 'event' and k2 <> 'entity'"), "anchor", "warn", F.array("src", "dst"), "an event is about an entity"))


def open_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Open questions without needs, and those with neither owner nor subject."""
    q = nodes.where("kind = 'question' and status = 'open'")
    lone = q.where("owner is null").join(edges.where("type = 'about'").select(F.col("src").alias("id")), "id", "left_anti")
    return found(q.where("needs is null"), "open-question", "warn", _one(), "says not what it needs").union(found(lone, "open-question", "warn", _one(), "has neither owner nor subject"))


def same_file_sources(nodes: DataFrame) -> DataFrame:
    """Several sources on one document without distinct anchors."""
    return found(dedupe.same_file(nodes), "same-file", "warn", F.col("ids"), F.concat(F.lit("stand on one document: "), F.col("doc")))


def unsourced(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Claims and events, asserted or proposed, without an attestation that stands; a person's signed ``unsupported`` takes one away."""
    cited = edges.where("type = 'attests'").select("src", "dst")
    if verdicts is not None:
        gone = subtracting(verdicts).select(F.col("source").alias("src"), F.col("fact").alias("dst"))
        cited = cited.join(gone, ["src", "dst"], "left_anti")
    facts = nodes.where(F.col("kind").isin("claim", "event") & F.col("status").isin("asserted", "proposed"))
    return found(facts.join(cited.select(F.col("dst").alias("id")), "id", "left_anti"), "unsourced", "warn", _one(), "nothing attests it")


def subtracting(verdicts: DataFrame) -> DataFrame:
    """The verdicts that take an attestation away: unsupported, by a signed person."""
    return verdicts.where("verdict = 'unsupported' and by_who is not null and not machine")


def ignored_verdicts(verdicts: DataFrame) -> DataFrame:
    """Unsupported by a machine or unsigned: it changes nothing."""
    return found(verdicts.where("verdict = 'unsupported' and (by_who is null or machine)"), "ignored-verdict", "warn", F.array("fact", "source"), "only a signed person takes an attestation away")


def underdetermined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims declared not one fact; once two supersede it, the claim should go."""
    n = edges.where("type = 'supersedes'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    rows = nodes.where("underdetermined is not null and status not in ('withdrawn', 'false')").join(n, "id", "left")
    return found(rows, "underdetermined", "warn", _one(), F.when(F.coalesce("n", F.lit(0)) >= 2, "is split: withdraw it").otherwise("is not one fact: split it"))


def open_supersession(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A superseded node that is neither withdrawn nor ended."""
    old = edges.where("type = 'supersedes'").select(F.col("dst").alias("id")).distinct()
    return found(nodes.join(old, "id", "left_semi").where("coalesce(status, '') not in ('withdrawn', 'false') and valid_until is null"), "supersession", "warn", _one(), "is superseded but has no end")


def inference_grounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inferences without premises, and those that attest to their own premise."""
    inf = nodes.where("form = 'inference'").select("id", "premises")
    bare = inf.where(F.size(F.coalesce("premises", F.array().cast("array<string>"))) == 0)
    own = inf.select("id", F.explode("premises").alias("dst")).join(edges.where("type = 'attests'").select(F.col("src").alias("id"), "dst"), ["id", "dst"], "left_semi")
    return found(bare, "inference", "warn", _one(), "has no premises").union(found(own, "inference", "error", F.array("id", "dst"), "attests to its own premise"))


def source_hygiene(nodes: DataFrame, edges: DataFrame, speakers: tuple[str, ...]) -> DataFrame:
    """Sources without class, speaker or use, long bodies, and attestations by what is no source."""
    src = nodes.where("kind = 'source'")
    wrong = edges.where("type = 'attests'").join(src.select(F.col("id").alias("src")), "src", "left_anti").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = [
        found(wrong, "source", "error", F.array("src", "dst"), "only a source attests"),
        found(src.where("class is null"), "source", "warn", _one(), "has no class"),
        found(src.where(F.col("class").isin(*speakers) & F.col("speaker").isNull()), "source", "error", _one(), "its class needs a speaker"),
        found(src.where(F.char_length("body") > MOST_BODY), "source", "warn", _one(), f"is longer than {MOST_BODY} characters"),
        found(src.join(used, "id", "left_anti"), "unreferenced", "warn", _one(), "is used nowhere"),
    ]
    return _all(parts)


def branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exclusive questions with several asserted options, and options that nothing hangs on."""
    o = nodes.where("kind = 'question' and size(options) > 0").select("id", "exhaustive", "status", F.explode("options").alias("option"))
    st = nodes.select(F.col("id").alias("option"), F.col("status").alias("o_status"))
    many = o.join(st, "option").where("o_status = 'asserted'").groupBy("id").agg(F.sort_array(F.collect_list("option")).alias("taken")).where(F.size("taken") > 1)
    hung = nodes.select(F.col("while").alias("option")).union(edges.select("while")).where("option is not null").distinct()
    bare = o.where("status = 'open'").join(hung, "option", "left_anti")
    return found(many, "branch", "error", F.concat(F.array("id"), F.col("taken")), "several options are asserted").union(found(bare, "branch", "warn", F.array("id", "option"), "nothing is planned for the option"))


def groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups without a rule or without members."""
    g = nodes.where("kind = 'group'")
    empty = g.join(edges.where("type = 'member_of'").select(F.col("dst").alias("id")), "id", "left_anti")
    return found(g.where("group_expr is null"), "group", "warn", _one(), "has no rule").union(found(empty, "group", "warn", _one(), "has no members"))


def split_sets(g: Graph, declared: dict[str, str]) -> DataFrame:
    """Declared sets that hold one end of a contradiction or the old end of a supersession without the other."""
    e = g.edges.where(F.col("type").isin("contradicts", "supersedes")).select("src", "dst", "type", "one_way")
    parts = []
    for name, text in declared.items():
        ids = g.eval(text)
        attesting = g.edges.where("type = 'attests'").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        there = ids.union(attesting).distinct()
        has = lambda x: there.select(F.col("id").alias(x), F.lit(True).alias(f"has_{x}"))  # noqa: E731, B023
        rows = e.join(has("src"), "src", "left").join(has("dst"), "dst", "left").select("src", "dst", "type", "one_way", F.coalesce("has_src", F.lit(False)).alias("s"), F.coalesce("has_dst", F.lit(False)).alias("d"))
        rows = rows.where((F.col("d") & ~F.col("s")) | (F.col("s") & ~F.col("d") & (F.col("type") == "contradicts") & ~F.col("one_way")))
        parts.append(found(rows, "split", "warn", F.array("src", "dst"), F.concat(F.lit(f"{name} holds one end of "), F.col("type"))))
    return _all(parts) if parts else _none(g.nodes)


def broad_sets(g: Graph, declared: dict[str, tuple[str, bool]]) -> DataFrame:
    """Declared sets (query, has a purpose) that hold nearly all nodes of their leftmost kinds."""
    from evigraph.plans import query as Q

    parts = []
    for name, (text, purpose) in declared.items():
        q = g.checked(text)
        kinds = q.atoms[0].kinds if isinstance(q, Q.Pattern) else ()
        if not kinds:
            continue
        n = g.eval(q).agg(F.count("*").alias("n"))
        total = g.nodes.where(F.col("kind").isin(*kinds)).agg(F.count("*").alias("total"))
        rows = n.join(total, how="inner").where((F.col("total") >= LEAST_POPULATION) & (F.col("n") * 100 >= F.col("total") * (BROAD_WITH_PURPOSE if purpose else BROAD)))
        parts.append(found(rows, "broad", "warn", F.array(F.lit(name)), F.concat(F.lit("holds "), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"))))
    return _all(parts) if parts else _none(g.nodes)


def empty_sets(g: Graph, declared: dict[str, str]) -> DataFrame:
    """Declared queries without rows."""
    parts = [found(g.eval(text).agg(F.count("*").alias("n")).where("n = 0"), "empty", "warn", F.array(F.lit(name)), "has no rows") for name, text in declared.items()]
    return _all(parts) if parts else _none(g.nodes)


def high_water(nodes: DataFrame, most_nodes: int) -> DataFrame:
    """A graph that lost all or more than half of the nodes it once had."""
    n = nodes.agg(F.count("*").alias("n")).withColumn("was", F.lit(most_nodes))
    none = found(n.where("n = 0 and was > 0"), "high-water", "error", F.array().cast("array<string>"), "all nodes are gone")
    return none.union(found(n.where("n > 0 and n * 2 < was"), "high-water", "warn", F.array().cast("array<string>"), "more than half of the nodes are gone"))


def index_boundary(nodes: DataFrame, folder: str) -> DataFrame:
    """Documents outside the index's folder."""
    path = F.col("doc")
    return found(nodes.where(path.isNotNull() & (path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")) & ~path.startswith(folder.rstrip("/") + "/")), "boundary", "warn", _one(), F.concat(F.lit("its document is outside: "), path))


def document_relations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Sources that cite a document ruled to be a copy or an older version of another (``relations(a, b, kind, supersedes)``)."""
    src = nodes.where("kind = 'source' and doc is not null").select("id", "doc")
    ruled = relations.where("kind in ('copy', 'version')")
    old = ruled.select(F.when(F.col("supersedes") == F.col("a"), F.col("b")).when(F.col("supersedes") == F.col("b"), F.col("a")).otherwise(F.greatest("a", "b")).alias("doc"), "kind", F.when(F.col("supersedes").isNotNull(), F.col("supersedes")).otherwise(F.least("a", "b")).alias("better"))
    return found(src.join(old, "doc"), "relation", "warn", _one(), F.concat(F.lit("its document is a "), F.col("kind"), F.lit(" of "), F.col("better")))


def duplicates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exact duplicates as errors, near ones as warnings."""
    e = found(dedupe.exact(nodes), "duplicate", "error", F.col("ids"), "say the same")
    n = dedupe.near(nodes, edges)
    return e.union(found(n, "near-duplicate", "warn", F.array("a", "b"), F.concat(F.lit("overlap "), F.format_number("score", 2))))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _none(df: DataFrame) -> DataFrame:
    return found(df.limit(0), "", "", F.array("id"), "")


def keyed(findings: DataFrame, hashes: DataFrame) -> DataFrame:
    """``findings`` with a key over the check and its sorted subjects with their hashes: it changes when a subject does."""
    rows = findings.withColumn("n", F.sha2(F.concat_ws("\0", "check", "message", F.array_join("subjects", "\0")), 256))
    with_hash = rows.select("n", F.explode("subjects").alias("id")).join(hashes.select("id", "sem_hash"), "id", "left").groupBy("n").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("@", "id", F.coalesce("sem_hash", F.lit(""))))), "\n").alias("s"))
    return rows.join(with_hash, "n", "left").withColumn("key", F.substring(F.sha2(F.concat_ws("\n", "check", F.coalesce("s", F.lit(""))), 256), 1, 16)).drop("n", "s")


def levelled(findings: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Warnings at the level that the index's rules give their check; errors stay."""
    level = F.col("severity")
    for check, says in rules.items():
        level = F.when((F.col("severity") == "warn") & (F.col("check") == check), says).otherwise(level)
    return findings.withColumn("severity", level).where("severity <> 'off'")


def triaged(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """``findings`` with whether a signed person accepted a warning of that key (``accepted(key, by_who, machine)``)."""
    ok = accepted.where("by_who is not null and not machine").select("key").distinct().withColumn("ok", F.lit(True))
    return findings.join(ok, "key", "left").withColumn("accepted", F.coalesce("ok", F.lit(False)) & (F.col("severity") == "warn")).drop("ok")


def run(g: Graph, verdicts: DataFrame | None = None, rules: dict[str, str] | None = None, declared: dict[str, str] | None = None) -> DataFrame:
    """All checks on a graph."""
    n, e = g.nodes, g.edges
    parts = [
        dangling(n, e), anchor_layers(n, e), open_questions(n, e), same_file_sources(n), unsourced(n, e, verdicts), underdetermined(n, e), open_supersession(n, e), inference_grounds(n, e),
        source_hygiene(n, e, g.dialect.speakers), branches(n, e), groups(n, e), duplicates(n, e),
    ]
    if g.names is not None:
        parts.append(alias_clashes(g.names))
    if verdicts is not None:
        parts.append(ignored_verdicts(verdicts))
    if declared:
        parts += [split_sets(g, declared), empty_sets(g, declared)]
    return levelled(_all(parts), {**g.dialect.rules, **(rules or {})})
