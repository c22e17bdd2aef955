"""The fold of a log to each id's last fields, and the operators that write new assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.model import LOG


def fold(log: DataFrame) -> DataFrame:
    """(id, fields, pos): what each id says after its whole log.

    Ordered by (at, pos). ``assert`` replaces all fields; ``withdraw`` sets status and reason and ``retire`` same_as, both only after
    an assertion; ids never asserted don't appear. ``pos`` is the order of first mention. One shuffle by id: everything is a partial
    aggregate over structs that compare by (at, pos), without a window.
    """
    when = F.struct(F.coalesce("at", F.lit("")).alias("at"), "pos")
    rows = log.select("id", "op", "fields", "reason", "into_id", when.alias("o"))

    def last(op, value=None):
        s = F.struct("o", value) if value is not None else F.struct("o")
        return F.max(F.when(F.col("op") == op, s))

    base = rows.groupBy("id").agg(
        F.min("o").alias("first"), F.max_by("fields", F.when(F.col("op") == "assert", F.col("o"))).alias("fields"), last("assert").alias("a"),
        last("withdraw", "reason").alias("w"), last("retire", "into_id").alias("r"),
    ).where("a is not null")
    # an act on an id counts if an assertion came before it, and stands if none came after: the last one decides both
    w = F.when(F.col("w.o") > F.col("a.o"), F.map_from_arrays(F.array(F.lit("status"), F.lit("reason")), F.array(F.lit("withdrawn"), F.coalesce("w.reason", F.lit("")))))
    r = F.when(F.col("r.o") > F.col("a.o"), F.map_from_arrays(F.array(F.lit("same_as")), F.array("r.into_id")))
    empty = F.create_map().cast("map<string,string>")
    changed = F.map_concat(F.coalesce(w, empty), F.coalesce(r, empty))
    kept = F.map_filter("fields", lambda k, _: ~F.map_contains_key(changed, k) & (k != "id"))
    return base.select("id", F.map_concat(kept, changed).alias("fields"), F.col("first").alias("pos"))


def ignored_acts(log: DataFrame) -> DataFrame:
    """(id, op, at) of withdrawals and retirements that no assertion came before."""
    when = F.struct(F.coalesce("at", F.lit("")).alias("at"), "pos")
    first = log.where("op = 'assert'").groupBy("id").agg(F.min(when).alias("first"))
    return log.where("op <> 'assert'").withColumn("o", when).join(first, "id", "left").where("first is null or o < first").select("id", "op", "at")


def latest(rows: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """The row of each key with the largest ``order``."""
    cols = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(cols, order).alias("last")).select(*keys, "last.*")


def last_fields(log: DataFrame) -> DataFrame:
    """(id, fields) of each id's last assertion."""
    when = F.struct(F.coalesce("at", F.lit("")).alias("at"), "pos")
    return log.where("op = 'assert'").groupBy("id").agg(F.max_by("fields", when).alias("fields"))


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], LOG)


def asserting(spark: SparkSession, node: str, fields: dict[str, str], by: str, at: str, note: str | None = None) -> DataFrame:
    """One assertion."""
    return _rows(spark, [("assert", node, fields, None, None, note, by, at)])


def withdrawing(spark: SparkSession, node: str, reason: str, by: str, at: str) -> DataFrame:
    """One withdrawal; the reason is needed."""
    if not reason:
        raise ValueError("a withdrawal needs a reason")
    return _rows(spark, [("withdraw", node, None, reason, None, None, by, at)])


def retiring(spark: SparkSession, node: str, survivor: str, by: str, at: str) -> DataFrame:
    """One retirement into another id."""
    if not survivor or survivor == node:
        raise ValueError("a retirement needs another survivor")
    return _rows(spark, [("retire", node, None, None, survivor, None, by, at)])


def _later(at: str) -> str:
    """A second after an RFC 3339 time; a plain date or other text gets a suffix that sorts after it."""
    from datetime import datetime, timedelta

    try:
        t = datetime.fromisoformat(at.replace("Z", "+00:00"))
    except ValueError:
        return at + "~"
    return (t + timedelta(seconds=1)).isoformat().replace("+00:00", "Z") if "T" in at else at + "T00:00:01Z"


def correcting(spark: SparkSession, old: str, reason: str, new: str, fields: dict[str, str], by: str, at: str) -> DataFrame:
    """Withdraw one node and assert another a second later that supersedes it."""
    if not reason:
        raise ValueError("a correction needs a reason")
    return _rows(spark, [("withdraw", old, None, reason, None, None, by, at), ("assert", new, {**fields, "supersedes": old}, None, None, None, by, _later(at))])


def answering(log: DataFrame, question: str, node: str, fields: dict[str, str], by: str, at: str) -> DataFrame:
    """Assert an answer, and the question again as resolved if its last fields are a question."""
    rows = [("assert", node, {**fields, "answers": question}, None, None, None, by, at)]
    last = last_fields(log.where(F.col("id") == question)).first()
    if last and "question" in last["fields"]:
        rows.append(("assert", question, {**last["fields"], "status": "resolved"}, None, None, None, by, _later(at)))
    return _rows(log.sparkSession, rows)


def amending(log: DataFrame, node: str, changes: dict[str, str | None], by: str, at: str) -> DataFrame:
    """Assert a node's last fields with changes; None drops a key."""
    last = last_fields(log.where(F.col("id") == node)).first()
    if not last:
        raise ValueError(f"{node!r} was never asserted")
    fields = {k: v for k, v in {**last["fields"], **changes}.items() if v is not None}
    return _rows(log.sparkSession, [("assert", node, fields, None, None, None, by, at)])


def merge_citations(fields: DataFrame, ids: list[str], key: str = "attested_by") -> DataFrame:
    """``fields(id, fields)`` with ids added to a list key; entries that are there keep their text."""
    old = F.coalesce(F.element_at("fields", F.lit(key)), F.lit(""))
    items = F.when(old.startswith("["), F.from_json(old, "array<string>")).when(old != "", F.array(old)).otherwise(F.array().cast("array<string>"))
    said = F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.id")).otherwise(F.regexp_replace(F.btrim(x), "^#", "")))
    new = F.filter(F.array(*map(F.lit, ids)), lambda x: ~F.array_contains(said, x))
    quoted = F.transform(items, lambda x: F.when(x.startswith("{"), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))))
    text = F.concat(F.lit("["), F.array_join(F.concat(quoted, F.transform(new, lambda x: F.concat(F.lit('"'), x, F.lit('"')))), ","), F.lit("]"))
    rest = F.map_filter("fields", lambda k, _: k != key)
    merged = F.map_concat(rest, F.map_from_arrays(F.array(F.lit(key)), F.array(text)))
    return fields.withColumn("fields", F.when(F.size(new) > 0, merged).otherwise(F.col("fields")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``ord`` from 1 in an order that must be short enough for one task: answers for people."""
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
