"""Vocabulary and schemas of the graph. Absent values are NULL everywhere; dates stay partial ISO strings."""

from __future__ import annotations

# Fixed values of the data model.
KINDS = ("claim", "question", "group", "entity", "event", "action", "source")
SOURCE_FORMS = ("document", "utterance", "record", "observation", "inference")
BODY_KEYS = {"claim": "claim", "question": "question", "group": "group", "entity": "entity", "event": "event", "action": "action", **dict.fromkeys(SOURCE_FORMS, "source")}
STATUSES = ("asserted", "proposed", "open", "resolved", "done", "withdrawn", "false")
HOLDING = ("asserted", "done", "resolved")
NEEDS = ("evidence", "decision", "reply", "analysis")
PRECISIONS = ("day", "month", "year", "approx")
CORE_EDGES = ("causes", "implies", "requires", "prohibits", "supports", "contradicts", "answers", "supersedes", "member_of", "about", "attests", "derived_from")
INVERSE_KEYS = {"attested_by": "attests", "answered_by": "answers", "undercut_by": "contradicts", "members": "member_of", "options": "answers"}
ONE_WAY_KEYS = ("undercut_by",)
LOG_OPS = ("assert", "withdraw", "retire")
VERDICTS = ("confirmed", "affirmed", "corrected", "unsupported", "unclear")
TRIM = ".,;:!?\"'()[]"
QUERY_FIELDS = (
    "id kind body status owner while unit precision valid_from valid_until from to computed class at value speaker medium needs disputed underdetermined impeached"
).split()
FLAG_FIELDS = ("computed", "disputed", "impeached")
DATE_FIELDS = ("at", "valid_from", "valid_until", "from", "to")
SCALAR_KEYS = (
    "id status owner reason title supersedes_reason while at from to valid_from valid_until precision value unit ordered exhaustive aliases "
    "underdetermined same_as needs by medium recorded doc anchor class derived_from"
).split()

LOG = "op string, id string, fields map<string,string>, reason string, into_id string, note string, by_who string, at string, pos long"
NODE = (
    "id string, kind string, body string, title string, status string, owner string, reason string, `while` string, at string, at_expr string, `from` string, `to` string, "
    "valid_from string, valid_until string, `precision` string, value double, value_expr string, unit string, needs string, underdetermined string, ordered boolean, exhaustive boolean, "
    "group_expr string, same_as string, options array<string>, aliases array<struct<as:string,from:string,until:string>>, "
    "form string, class string, speaker string, medium string, recorded boolean, doc string, anchor string, premises array<string>, bag map<string,string>, pos long"
)
EDGE = "src string, dst string, type string, valid_from string, valid_until string, `while` string, because string, one_way boolean, pos long"
DIAG = "check string, severity string, subjects array<string>, message string"
