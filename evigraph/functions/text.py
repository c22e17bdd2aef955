"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.model import TRIM

#: Registry prefixes that an identifier may carry (fixed values), and how much must remain without one.
REGISTRY_PREFIXES = ("af", "afn", "afno", "pl", "form", "rec", "vol")
LEAST_IDENTIFIER = 4


def words(c: Column) -> Column:
    """The parts of a text between runs of Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def normalized(c: Column) -> Column:
    """Lower case, single spaces, and punctuation cut from both ends of each word."""
    return F.array_join(F.transform(words(F.lower(c)), lambda w: F.btrim(w, F.lit(TRIM))), " ")


def tokens(c: Column) -> Column:
    """The distinct words of a normalized text that are longer than a byte."""
    return F.array_distinct(F.filter(F.split(normalized(c), " "), lambda w: F.octet_length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of the tokens of two texts."""
    return jaccard(tokens(a), tokens(b))


def folded(c: Column) -> Column:
    """Letters and digits of a text in lower case, without page stars like ``*123``."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\*[0-9]+", ""), r"[^\p{L}\p{Nd}]", "")


def quoted_spans(c: Column, least: int = 40) -> Column:
    """The quoted passages of a text: curly pairs, and every second part between straight quotes.

    Bracketed insertions of at most 20 characters are cut, an ellipsis splits a passage, and parts whose folded form has fewer than
    ``least`` characters are left out.
    """
    curly = F.regexp_extract_all(c, F.lit("“([^“”]{4,400})”"), 1)
    straight = F.filter(F.split(c, '"'), lambda _, i: i % 2 == 1)
    straight = F.when(F.size(F.split(c, '"')) % 2 == 0, F.slice(straight, 1, F.greatest(F.size(straight) - 1, F.lit(0)))).otherwise(straight)
    parts = F.flatten(F.transform(F.concat(curly, straight), lambda q: F.split(F.regexp_replace(q, r"\[[^\]]{0,20}\]", " "), r"…|\.\.\.")))
    return F.filter(parts, lambda p: F.char_length(folded(p)) >= least)


def line_of(text: Column, place: Column) -> Column:
    """The line, from 1, of a place (from 1) in a text."""
    head = F.substring(text, F.lit(1), place - 1)
    return F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def page_of(text: Column, place: Column) -> Column:
    """The number of the last ``## Page N`` heading at or before a place; NULL without one."""
    return F.try_element_at(F.regexp_extract_all(F.concat(F.lit("\n"), F.substring(text, F.lit(1), place - 1)), F.lit(r"\n## Page ([0-9]+)"), 1), F.lit(-1)).cast("int")


def identifier(c: Column) -> Column:
    """An identifier's letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def identifier_forms(c: Column) -> Column:
    """The normal form of an identifier, and those without a registry prefix where enough remains."""
    whole = identifier(c)
    bare = [F.when(whole.startswith(p) & (F.length(whole) >= len(p) + LEAST_IDENTIFIER), F.substring(whole, len(p) + 1, 10**6)) for p in REGISTRY_PREFIXES]
    return F.array_distinct(F.array_compact(F.array(whole, *bare)))


#: Patterns of registry numbers (fixed values); bare runs of 8 to 14 digits count as well.
IDENTIFIER_PATTERNS = (r"(?i)(\bAF\s*#?\s*\d{8,14}\b)", r"(?i)(\bPL\s*\d{2}\s*-\s*\d{4}\b)", r"(?i)(\bForm\s+\d{1,3}\s*[A-Z]?\b)")


def identifiers(c: Column) -> Column:
    """The normal forms of the identifiers in a text."""
    found = [F.regexp_extract_all(c, F.lit(p), 1) for p in (*IDENTIFIER_PATTERNS, r"(\d{8,14})")]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), identifier), lambda x: x != ""))


#: Words that say nothing about a subject (fixed values).
STOP_WORDS = (
    "about after again against also back because been before being both came come could did does down each even "
    "ever every from gave give goes gone had has have here how into just know like made make many more most much "
    "must near need never next not now only onto other our out over own said same says she should since some such "
    "take than that the their them then there these they this those through time under upon very was well went were "
    "what when where which while who will with would your"
).split()


def content_terms(c: Column, named: Column | None = None) -> Column:
    """Distinct words of 4 letters or more, or of 2 digits or more, without stop words and without pieces of the ``named`` identifiers."""
    found = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.when(w.rlike(r"^[0-9]+$"), F.length(w) >= 2).otherwise(F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    if named is not None:
        found = F.filter(found, lambda w: ~F.exists(named, lambda i: F.contains(i, w)))
    return F.array_distinct(found)


def term_hits(wanted: Column, there: Column) -> Column:
    """How many wanted terms are there, if it is enough: both of two, else at least three; otherwise 0."""
    both = F.size(F.array_intersect(wanted, there))
    return F.when((both >= 3) | ((F.size(wanted) == 2) & (both == 2)), both).otherwise(0)


def excerpt(c: Column, most: int = 160) -> Column:
    """A text on one line, cut to ``most`` characters."""
    one = F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.char_length(one) <= most, one).otherwise(F.concat(F.left(one, F.lit(most - 1)), F.lit("…")))


def snippet(text: Column, place: Column, before: int = 90, after: int = 150) -> Column:
    """The surroundings of a place (from 1) on one line."""
    start = F.greatest(place - before, F.lit(1))
    return excerpt(F.substring(text, start, place - start + after), before + after)


def first_line(c: Column) -> Column:
    """The first line that isn't blank."""
    return F.try_element_at(F.filter(F.transform(F.split(c, "\n"), F.btrim), lambda x: x != ""), F.lit(1))


def label(node_id: Column, kind: Column, body: Column, title: Column, rule: Column) -> Column:
    """How a node is written in reports: its body with the id, a group by its title or rule."""
    said = F.when(kind == "group", F.coalesce(title, rule)).otherwise(body)
    return F.when(said.isNull(), node_id).otherwise(F.concat(said, F.lit(" ("), node_id, F.lit(")")))


def text_terms(c: Column, least: int = 6) -> Column:
    """The three longest distinct words of at least ``least`` letters: anchors for a search of near misses."""
    found = F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: F.char_length(w) >= least))
    order = F.array_sort(F.transform(found, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(order, 1, 3), lambda x: x["w"])


def quote_diff(authored: Column, document: Column, most: int = 12) -> Column:
    """``-word`` for words that only the quotation has and ``+word`` for those only the document has, at most ``most``."""
    a, b = words(F.lower(authored)), words(F.lower(document))
    gone = F.transform(F.array_except(a, b), lambda w: F.concat(F.lit("-"), w))
    new = F.transform(F.array_except(b, a), lambda w: F.concat(F.lit("+"), w))
    return F.array_join(F.slice(F.concat(gone, new), 1, most), " ")
