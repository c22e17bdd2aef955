"""Folded fields to typed nodes, edges and diagnostics, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.compare import NUMBER
from evigraph.model import BODY_KEYS, CORE_EDGES, EDGE, INVERSE_KEYS, NEEDS, ONE_WAY_KEYS, PRECISIONS, SCALAR_KEYS, SOURCE_FORMS, STATUSES
from evigraph.sources.dialect import LEGAL, Dialect

GROUP_RULE = r"^(all|any|none|sum\(.*\)|(>=|<=|==|>|<)\s*[0-9]+)$"
_EDGE_FIELDS = ("valid_from", "valid_until", "while", "because")


def _field(key: str) -> Column:
    v = F.element_at("fields", F.lit(key))
    return F.when(v != "", v)


def _plain(v: Column) -> Column:
    """An id as written, without a leading # and outer blanks."""
    return F.regexp_replace(F.btrim(v), "^#", "")


def _items(v: Column) -> Column:
    """A value as a list: a JSON list's items as text, or the one scalar; NULL gives none."""
    return F.when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))


def _ids(v: Column) -> Column:
    """The ids of a list value; structs count by their id."""
    found = F.transform(_items(v), lambda x: _plain(F.when(x.startswith("{"), F.get_json_object(x, "$.id")).otherwise(x)))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def _refs(v: Column) -> Column:
    """A relation's value as structs of id, valid_from, valid_until, while and because."""

    def one(x):
        js = x.startswith("{")
        cols = [_plain(F.when(js, F.get_json_object(x, "$.id")).otherwise(x)).alias("id")]
        for k in _EDGE_FIELDS:
            raw = F.get_json_object(x, f"$.{k}")
            raw = F.btrim(raw) if k == "because" else _plain(raw)
            cols.append(F.when(js & (raw != ""), raw).alias(k))
        return F.struct(*cols)

    return F.filter(F.transform(_items(v), one), lambda r: r["id"].isNotNull() & (r["id"] != ""))


def is_edge_entry() -> Column:
    """Whether fields state a relation of their own: from and to, and no body."""
    bodies = [~F.map_contains_key("fields", F.lit(k)) for k in BODY_KEYS]
    out = F.map_contains_key("fields", F.lit("from")) & F.map_contains_key("fields", F.lit("to"))
    for b in bodies:
        out = out & b
    return out


def nodes(folded: DataFrame, dialect: Dialect = LEGAL) -> DataFrame:
    """The nodes of ``folded(id, fields, pos)``. Which of several body keys counts, and what else is wrong, :func:`faults` says."""

    rows = folded.where(~is_edge_entry())
    # the first body key in the fixed order, as maps have none
    kind, form, body = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(BODY_KEYS):
        has = F.map_contains_key("fields", F.lit(k))
        kind, body = F.when(has, F.lit(BODY_KEYS[k])).otherwise(kind), F.when(has, F.element_at("fields", F.lit(k))).otherwise(body)
        form = F.when(has, F.lit(k if k in SOURCE_FORMS else None)).otherwise(form)
    rows = rows.withColumns({"kind": kind, "form_": form, "body_": body}).where("kind is not null")
    is_group, at, value, status = F.col("kind") == "group", _field("at"), _field("value"), _field("status")
    precision = _field("precision")
    inferred = F.when(F.length(at) == 4, "year").when(F.length(at) == 7, "month").otherwise("day")
    aliases = F.filter(
        F.transform(
            _items(_field("aliases")),
            lambda x: F.struct(
                F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.as"), F.get_json_object(x, "$.name"))).otherwise(x).alias("as"),
                F.when(x.startswith("{"), F.get_json_object(x, "$.from")).alias("from"), F.when(x.startswith("{"), F.get_json_object(x, "$.until")).alias("until"),
            ),
        ),
        lambda a: a["as"].isNotNull() & (a["as"] != ""),
    )
    governed = [k for _, keys in dialect.subtypes.values() for k in keys]
    bag = F.map_filter("fields", lambda k, _: k.isin(*governed)) if governed else F.lit(None).cast("map<string,string>")
    cols = {
        "id": F.col("id"), "kind": F.col("kind"), "body": F.when(~is_group & (F.col("body_") != ""), F.col("body_")), "title": F.when(is_group, _field("title")), "status": F.when(status.isin(*STATUSES), status),
        "owner": _field("owner"), "reason": _field("reason"), "while": _field("while"), "at": F.when(~at.startswith("="), at), "at_expr": F.when(at.startswith("="), at), "from": _field("from"), "to": _field("to"),
        "valid_from": _field("valid_from"), "valid_until": _field("valid_until"), "precision": F.when(precision.isin(*PRECISIONS), precision).otherwise(F.when(at.startswith("="), "day").otherwise(inferred)),
        "value": F.when(value.rlike(NUMBER), value.cast("double")), "value_expr": F.when(value.startswith("="), value), "unit": _field("unit"), "needs": F.when(_field("needs").isin(*NEEDS), _field("needs")),
        "underdetermined": F.array_join(F.filter(F.split(_field("underdetermined"), r"\s+"), lambda w: w != ""), " "), "ordered": F.coalesce(_field("ordered") == "true", F.lit(False)), "exhaustive": F.coalesce(_field("exhaustive") == "true", F.lit(False)),
        "group_expr": F.when(is_group, F.col("body_")), "same_as": _field("same_as"), "options": _ids(_field("options")), "aliases": aliases,
        "form": F.col("form_"), "class": F.when(_field("class").isin(*dialect.classes), _field("class")), "speaker": _field("by"), "medium": _field("medium"), "recorded": F.coalesce(_field("recorded") == "true", F.lit(False)),
        "doc": _field("doc"), "anchor": _field("anchor"), "premises": _ids(_field("derived_from")), "bag": bag, "pos": F.col("pos"),
    }
    return rows.select(*(c.alias(k) for k, c in cols.items()))


def edges(folded: DataFrame, dialect: Dialect = LEGAL) -> DataFrame:
    """The edges that fields state: relations under their own or an inverse key, premises, and entries with from and to."""
    own = folded.where(~is_edge_entry())
    forward = [*(k for k in CORE_EDGES if k != "derived_from"), *dialect.edges]
    stated = []
    for key in (*forward, *INVERSE_KEYS):
        kind, inverse = INVERSE_KEYS.get(key, key), key in INVERSE_KEYS
        stated.append(F.struct(F.lit(kind).alias("type"), F.lit(inverse).alias("inverse"), F.lit(key in ONE_WAY_KEYS).alias("one_way"), _refs(_field(key)).alias("refs")))
    premises = F.transform(_ids(_field("derived_from")), lambda x: F.struct(x.alias("id"), *(F.lit(None).cast("string").alias(k) for k in _EDGE_FIELDS)))
    stated.append(F.struct(F.lit("derived_from").alias("type"), F.lit(False).alias("inverse"), F.lit(False).alias("one_way"), premises.alias("refs")))
    # only keys that are there make rows
    rows = own.select("id", "pos", F.explode(F.filter(F.array(*stated), lambda s: F.size(s["refs"]) > 0)).alias("s")).select("id", "pos", "s.*", F.explode("s.refs").alias("r")).drop("refs")
    ends = [F.when(F.col("inverse"), x).otherwise(y) for x, y in ((F.col("r.id"), F.col("id")), (F.col("id"), F.col("r.id")))]
    first = rows.select(ends[0].alias("src"), ends[1].alias("dst"), "type", *(F.col(f"r.{k}").alias(k) for k in _EDGE_FIELDS), "one_way", "pos")
    alone = folded.where(is_edge_entry() & F.coalesce(_field("status") != "withdrawn", F.lit(True)))
    kind = _field("is")
    turned = F.lit(False)
    named = kind
    for k, e in INVERSE_KEYS.items():
        named, turned = F.when(kind == k, F.lit(e)).otherwise(named), turned | F.coalesce(kind == k, F.lit(False))
    a, b = _plain(_field("from")), _plain(_field("to"))
    second = alone.select(
        F.when(turned, b).otherwise(a).alias("src"), F.when(turned, a).otherwise(b).alias("dst"), named.alias("type"), *(_field(k).alias(k) for k in _EDGE_FIELDS), F.coalesce(kind.isin(*ONE_WAY_KEYS), F.lit(False)).alias("one_way"), "pos"
    ).where(F.col("type").isin(*CORE_EDGES, *dialect.edges))
    return first.unionByName(second).select(*(F.col(f"`{c}`") for c in _names(EDGE)))


def _names(schema: str) -> list[str]:
    import re

    return re.findall(r"(?:^|, )`?([a-z_]+)`? ", re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", schema))


def faults(folded: DataFrame, dialect: Dialect = LEGAL) -> DataFrame:
    """(check, severity, subjects, message): what entries say that the schema doesn't allow."""
    keys = F.map_keys("fields")
    governed = [k for _, ks in dialect.subtypes.values() for k in ks]
    known = {*BODY_KEYS, *CORE_EDGES, *INVERSE_KEYS, *SCALAR_KEYS, *dialect.edges, *governed, "is", "id"}
    unknown = F.filter(keys, lambda k: ~k.isin(*known))
    bodies = F.filter(keys, lambda k: k.isin(*BODY_KEYS))
    value, status, group = _field("value"), _field("status"), _field("group")
    opens = lambda o, c: F.length(F.regexp_replace(group_or_body, f"[^{o}]", "")) != F.length(F.regexp_replace(group_or_body, f"[^{c}]", ""))
    group_or_body = F.coalesce(*(_field(k) for k in BODY_KEYS))
    tests = [
        ("entry", "error", F.size(bodies) > 1, F.concat(F.lit("declares several kinds: "), F.array_join(bodies, ", "))),
        ("entry", "error", F.size(bodies) == 0, F.lit("declares no kind")),
        ("entry", "error", F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_sort(unknown), ", "))),
        ("entry", "error", status == "disputed", F.lit("disputed is computed, never authored")),
        ("entry", "error", status.isNotNull() & ~status.isin(*STATUSES, "disputed"), F.concat(F.lit("unknown status "), status)),
        ("entry", "error", _field("needs").isNotNull() & ~_field("needs").isin(*NEEDS), F.concat(F.lit("unknown needs "), _field("needs"))),
        ("entry", "error", _field("precision").isNotNull() & ~_field("precision").isin(*PRECISIONS), F.concat(F.lit("unknown precision "), _field("precision"))),
        ("entry", "error", value.isNotNull() & ~value.startswith("=") & ~value.rlike(NUMBER), F.concat(F.lit("not a number: "), value)),
        ("entry", "error", _field("class").isNotNull() & ~_field("class").isin(*dialect.classes), F.concat(F.lit("unknown class "), _field("class"))),
        ("entry", "error", group.isNotNull() & ~F.btrim(group).rlike(GROUP_RULE), F.concat(F.lit("not a group rule: "), group)),
        ("entry", "error", _field("title").isNotNull() & group.isNull(), F.lit("a title names groups only")),
        ("entry", "error", _field("same_as") == F.col("id"), F.lit("same_as names itself")),
        ("entry", "error", _field("underdetermined").isin("true", "false", "yes", "no"), F.lit("underdetermined takes a reason")),
        ("truncated", "warn", opens(r"\(", r"\)") | opens(r"\[", r"\]"), F.lit("the body has an unbalanced bracket")),
        ("idiom", "warn", _field("question").isNotNull() & (_field("supports").isNotNull() | _field("answers").isNotNull()), F.lit("a question neither supports nor answers")),
    ]
    own = folded.where(~is_edge_entry())
    found = F.array(*(F.when(c, F.struct(F.lit(check).alias("check"), F.lit(sev).alias("severity"), F.array("id").alias("subjects"), msg.alias("message"))) for check, sev, c, msg in tests))
    return own.select(F.explode(F.array_compact(found)).alias("d")).select("d.*")


def routed_keys(fields: DataFrame, dialect: Dialect) -> DataFrame:
    """(id, subtype, key, value) of the keys that an entry's subtypes govern; a prefixed key names its subtype."""
    rows = [(name, k) for name, (_, keys) in dialect.subtypes.items() for k in keys]
    known = fields.sparkSession.createDataFrame(rows, "subtype string, key string")
    carried = fields.select("id", "fields", F.explode(_ids(_field("is"))).alias("subtype"))
    return carried.select("id", "subtype", F.explode("fields").alias("key", "value")).join(F.broadcast(known), ["subtype", "key"]).select("id", "subtype", "key", "value")


def raw_entries(spark, text: str) -> list[dict]:
    """Entries of YAML text (or of ```` ```facts ```` fences in Markdown) as string maps; the migration's reader, on the driver."""
    import json
    import re

    import yaml

    blocks = re.findall(r"^```[a-z]*\n(.*?)^```", text, re.S | re.M) or [text]
    out = []
    for block in blocks:
        for entry in yaml.load(block, yaml.BaseLoader) or []:  # noqa: S506  the base loader makes strings only
            if not isinstance(entry, dict):
                raise ValueError("each list item must be a mapping")
            out.append({k: v if isinstance(v, str) else json.dumps(v) for k, v in entry.items()})
    return out


