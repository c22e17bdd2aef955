"""Quotations against documents: present, near, absent or unreadable, with page, line and other homes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.sound import near_miss
from evigraph.functions.text import folded, line_of, page_of, quote_diff, quoted_spans, text_terms

PIECE = 24


def quotes_of(nodes: DataFrame) -> DataFrame:
    """(id, quote, fold): the quotations long enough to check in each node's body."""
    rows = nodes.where("body is not null").select("id", F.explode(quoted_spans(F.col("body"))).alias("quote"))
    return rows.select("id", F.btrim("quote").alias("quote"), folded(F.col("quote")).alias("fold"))


def cited_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, doc): the documents that attest a node, and its own if it is a source."""
    src = nodes.where("kind = 'source' and doc is not null").select(F.col("id").alias("src"), "doc")
    return edges.where("type = 'attests'").select("src", "dst").join(src, "src").select(F.col("dst").alias("id"), "doc").union(src.select(F.col("src").alias("id"), "doc")).distinct()


def homes(quotes: DataFrame, texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(fold, path): the documents that contain each folded quotation anywhere.

    No product of quotations and documents: each quotation is keyed by the hash of its first ``piece`` characters, each document by those
    of all its windows of that length, and only pairs with equal keys fetch the text and are compared in full.
    """
    q = quotes.select("fold").distinct().where(F.char_length("fold") >= piece).withColumn("k", F.xxhash64(F.substring("fold", 1, piece)))
    d = texts.where("text is not null").select("path", folded(F.col("text")).alias("f"))
    last = F.greatest(F.char_length("f") - piece + 1, F.lit(0))
    # keys alone are exploded: a row for each window must not carry its whole text
    windows = d.where(F.char_length("f") >= piece).select("path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(F.col("f"), i, F.lit(piece)))))).alias("k"))
    near = windows.join(q, "k").select("path", "fold").distinct()
    return near.join(d, "path").where(F.contains("f", "fold")).select("fold", "path").distinct()


def checked(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, quote, doc, state, page, line, passage, ratio, diff, elsewhere, n_elsewhere) of each quotation and each cited document.

    present: the folded words stand in the document; near: a passage has at least three quarters of its words in order; absent; and
    unreadable where the document has no text. ``elsewhere`` is the first other document that has the words.
    """
    q = quotes_of(nodes)
    rows = q.join(cited_documents(nodes, edges), "id").join(texts.select(F.col("path").alias("doc"), "text"), "doc", "left")
    rows = rows.withColumn("doc_fold", folded(F.col("text")))
    has = F.contains("doc_fold", "fold")
    # where the first two words stand; page and line are read from there
    place = F.greatest(F.expr(r"instr(text, regexp_extract(quote, '^(\\S+\\s+\\S+)', 1))"), F.lit(1))
    rows = rows.withColumns({"has": has, "place": place})
    miss = rows.where(F.col("text").isNotNull() & ~F.col("has")).select("id", "quote", "doc", near_miss("quote", "text").alias("m"))
    rows = rows.join(miss.withColumnsRenamed({"id": "i", "quote": "qq", "doc": "dd"}), (F.col("id") == F.col("i")) & (F.col("quote") == F.col("qq")) & (F.col("doc") == F.col("dd")), "left")
    other = homes(q, texts).withColumnRenamed("path", "home")
    away = rows.where(~F.coalesce("has", F.lit(False))).select("id", "quote", "doc", "fold").join(other, "fold").where("home <> doc").groupBy("id", "quote", "doc").agg(F.min("home").alias("elsewhere"), F.count("*").alias("n_elsewhere"))
    rows = rows.join(away, ["id", "quote", "doc"], "left")
    state = F.when(F.col("text").isNull(), "unreadable").when(F.col("has"), "present").when(F.col("m.passage").isNotNull(), "near").otherwise("absent")
    return rows.select(
        "id", "quote", "doc", state.alias("state"), F.when(F.col("has"), page_of(F.col("text"), F.col("place"))).alias("page"), F.when(F.col("has"), line_of(F.col("text"), F.col("place"))).alias("line"),
        F.col("m.passage").alias("passage"), F.col("m.ratio").alias("ratio"), F.when(F.col("m.passage").isNotNull(), quote_diff(F.col("quote"), F.col("m.passage"))).alias("diff"), "elsewhere", F.coalesce("n_elsewhere", F.lit(0)).alias("n_elsewhere"),
    )


def probe(texts: DataFrame, path: str, quote: str) -> tuple[bool, bool]:
    """(present, readable) of one quotation in one document."""
    r = texts.where(F.col("path") == path).select(F.col("text").isNotNull().alias("readable"), F.contains(folded(F.col("text")), folded(F.lit(quote))).alias("present")).first()
    return (bool(r["present"]), bool(r["readable"])) if r else (False, False)


def excerpt_states(verdicts: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(fact, source, state) of verdicts with an excerpt: intact, document-moved, fact-moved or unreadable.

    ``verdicts(fact, source, doc, excerpt, fact_hash)`` against ``facts(id, sem_hash)`` and the documents' texts.
    """
    rows = verdicts.where("excerpt is not null").join(texts.select(F.col("path").alias("doc"), "text"), "doc", "left").join(facts.select(F.col("id").alias("fact"), "sem_hash"), "fact", "left")
    state = F.when(F.col("text").isNull(), "unreadable").when(~F.contains(folded(F.col("text")), folded(F.col("excerpt"))), "document-moved").when(~F.col("fact_hash").eqNullSafe(F.col("sem_hash")), "fact-moved").otherwise("intact")
    return rows.select("fact", "source", state.alias("state"))


def anchors(c):
    """The words around which a near miss is searched."""
    return text_terms(c)


def without_line_numbers(docs: DataFrame) -> DataFrame:
    """(path, text): texts without pleading line numbers: numbers are cut where at least 8 lines, and one in five, of the 41 around are numbered."""
    from pyspark.sql import Window

    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    mark = F.col("line").rlike(r"^[\t\p{Zs}]{0,4}[0-9]{1,2}[\t\p{Zs}]+\S").cast("int")
    full = (F.btrim("line") != "").cast("int")
    w = Window.partitionBy("path").orderBy("n").rowsBetween(-20, 20)
    marked = lines.withColumns({"mark": mark, "near": F.sum(mark).over(w), "full": F.sum(full).over(w)})
    dense = (F.col("mark") == 1) & (F.col("near") >= 8) & (F.col("near") * 5 >= F.col("full"))
    cut = F.when(dense, F.regexp_replace("line", r"^[\t\p{Zs}]{0,4}[0-9]{1,2}[\t\p{Zs}]+", "")).otherwise(F.col("line"))
    return marked.select("path", F.struct("n", cut.alias("line")).alias("l")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
