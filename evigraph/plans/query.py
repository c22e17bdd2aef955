"""The path language: text to frozen dataclasses, and their validation against the schema.

    query    = inter ("|" inter)*          inter = unary ("&" unary)*        unary = "!" unary | primary
    primary  = "@" name | "(" query ")" suffix | pattern
    pattern  = atom (hop atom)* suffix     suffix = ["@" when] ["sort" key ("," key)*]
    hop      = "-" edge ["*"] "->" | "<-" edge ["*"] "-" | "-" edge ["*"] "-"
    atom     = [kind | "(" kind ("|" kind)* ")"] ["#" id] ["[" pred ("," pred)* "]"] ["~" string]
    when     = "now" | date | "[" date "," date "]"
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from typing import Any

from evigraph.model import CORE_EDGES, DATE_FIELDS, FLAG_FIELDS, KINDS, NEEDS, QUERY_FIELDS, STATUSES


class QueryError(ValueError):
    """The text isn't a query, or names something unknown."""


@dataclass(frozen=True)
class When:
    start: str | None = None
    end: str | None = None
    now: bool = False

    @property
    def window(self) -> bool:
        return not self.now and self.end is not None and self.end != self.start


@dataclass(frozen=True)
class Pred:
    key: str
    op: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Atom:
    kinds: tuple[str, ...] = ()
    ref: str | None = None
    preds: tuple[Pred, ...] = ()
    text: str | None = None


@dataclass(frozen=True)
class Hop:
    edge: str
    direction: int
    star: bool = False


@dataclass(frozen=True)
class SortKey:
    key: str
    descending: bool = False


@dataclass(frozen=True)
class Pattern:
    atoms: tuple[Atom, ...]
    hops: tuple[Hop, ...] = ()
    at: When | None = None
    sort: tuple[SortKey, ...] = ()


@dataclass(frozen=True)
class Scoped:
    inner: Any
    at: When | None = None
    sort: tuple[SortKey, ...] = ()


@dataclass(frozen=True)
class Named:
    name: str


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class And:
    terms: tuple


@dataclass(frozen=True)
class Or:
    terms: tuple


_WORD = r"[^\W_](?:[\w.]|-(?=[^\W_]))*"
_SCAN = re.compile(rf'(?P<space>[ \t\r\n]+)|"(?P<string>[^"]*)"|(?P<value>(?=\d){_WORD})|(?P<name>(?=[^\W\d])(?:{_WORD})|_(?:[\w.]|-(?=[^\W_]))*)|(?P<sign>->|<-|!=|<=|>=|[()\[\]#@~&|!,*=<>-])')


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    place: int


def tokenize(source: str) -> list[Token]:
    """The tokens of a query; a dash belongs to a word only before a letter or digit."""
    out, at = [], 0
    while at < len(source):
        m = _SCAN.match(source, at)
        if not m:
            raise QueryError(f"unterminated string at {at}" if source[at] == '"' else f"unexpected character {source[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[m.lastgroup], at))
        at = m.end()
    return [*out, Token("end", "", len(source))]


class _Reader:
    def __init__(self, source: str):
        self.tokens, self.at = tokenize(source), 0

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def sign(self, *texts: str) -> bool:
        return self.token.kind == "sign" and self.token.text in texts

    def took(self, text: str) -> bool:
        if self.sign(text):
            self.at += 1
            return True
        return False

    def take(self, *kinds: str) -> str:
        if self.token.kind not in kinds:
            self.fail(" or ".join(kinds))
        self.at += 1
        return self.tokens[self.at - 1].text

    def need(self, text: str) -> None:
        if not self.took(text):
            self.fail(repr(text))

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted}, got {self.token.text or 'the end'!r} at {self.token.place}")

    def word(self, text: str) -> bool:
        if self.token.kind == "name" and self.token.text == text:
            self.at += 1
            return True
        return False

    def joined(self, sign: str, item, make):
        terms = [item()]
        while self.took(sign):
            terms.append(item())
        return terms[0] if len(terms) == 1 else make(tuple(terms))

    def query(self):
        return self.joined("|", self.inter, Or)

    def inter(self):
        return self.joined("&", self.unary, And)

    def unary(self):
        return Not(self.unary()) if self.took("!") else self.primary()

    def primary(self):
        if self.sign("@") and self.peek().kind == "name" and self.peek().text != "now":
            self.at += 1
            return Named(self.take("name"))
        if self.sign("(") and not self.kinds_follow():
            self.at += 1
            inner = self.query()
            self.need(")")
            at, sort = self.suffix()
            return Scoped(inner, at, sort) if at or sort else inner
        atoms, hops = [self.atom()], []
        while self.sign("<-", "-"):
            hops.append(self.hop())
            atoms.append(self.atom())
        return Pattern(tuple(atoms), tuple(hops), *self.suffix())

    def kinds_follow(self) -> bool:
        k = self.at + 1
        while self.tokens[k].kind == "name" and self.tokens[k].text in KINDS:
            nxt = self.tokens[k + 1]
            if nxt.kind == "sign" and nxt.text == ")":
                return True
            if not (nxt.kind == "sign" and nxt.text == "|"):
                return False
            k += 2
        return False

    def suffix(self):
        at, sort = None, ()
        if self.took("@"):
            at = self.when()
        if self.word("sort"):
            keys = []
            while True:
                key = self.take("name")
                descending = self.word("desc")
                if not descending:
                    self.word("asc")
                keys.append(SortKey(key, descending))
                if not self.took(","):
                    break
            sort = tuple(keys)
        return at, sort

    def when(self) -> When:
        if self.word("now"):
            return When(now=True)
        if self.took("["):
            start = self.take("value")
            self.need(",")
            end = self.take("value")
            self.need("]")
            return When(start, end)
        d = self.take("value")
        return When(d, d)

    def hop(self) -> Hop:
        inverse = self.took("<-")
        if not inverse:
            self.need("-")
        edge = self.take("name")
        star = self.took("*")
        if self.took("->"):
            if inverse:
                raise QueryError(f"`<-{edge}->` is not a direction")
            return Hop(edge, 1, star)
        self.need("-")
        return Hop(edge, -1 if inverse else 0, star)

    def atom(self) -> Atom:
        kinds, ref, preds, text = [], None, [], None
        begin = self.token
        if self.took("("):
            kinds.append(self.take("name"))
            while self.took("|"):
                kinds.append(self.take("name"))
            self.need(")")
        elif self.token.kind == "name" and self.token.text in KINDS:
            kinds.append(self.take("name"))
        if self.took("#"):
            ref = self.take("name", "value", "string")
        if self.took("["):
            preds.append(self.pred())
            while self.took(","):
                preds.append(self.pred())
            self.need("]")
        if self.took("~"):
            text = self.take("string")
        if not (kinds or ref or preds or text):
            raise QueryError(f"empty atom at {begin.place}")
        return Atom(tuple(kinds), ref or None, tuple(preds), text or None)

    def pred(self) -> Pred:
        key = self.take("name")
        if self.word("in"):
            self.need("(")
            values = [self.take("name", "value", "string")]
            while self.took(","):
                values.append(self.take("name", "value", "string"))
            self.need(")")
            return Pred(key, "in", tuple(values))
        if self.sign("!=", "<=", ">=", "=", "<", ">"):
            op = self.take("sign")
            values = [self.take("name", "value", "string")]
            while self.took("|"):
                values.append(self.take("name", "value", "string"))
            if len(values) > 1 and op != "=":
                raise QueryError(f"`{op}` takes one value")
            return Pred(key, "in" if len(values) > 1 else op, tuple(values))
        return Pred(key, "has")


def parse(source: str):
    """The query that a text says; QueryError if it says none."""
    r = _Reader(source)
    q = r.query()
    if r.token.kind != "end":
        r.fail("the end")
    return q


_DATE = re.compile(r"\d{4}(-\d{2}(-\d{2})?)?")


def problems(query, classes: tuple[str, ...], extra_edges: tuple[str, ...] = ()) -> list[str]:
    """What a query names that the schema or the dialect doesn't have, and values that a field can't take."""
    out: list[str] = []

    def sorts(keys):
        out.extend(f"unknown sort field {k.key!r}" for k in keys if k.key not in QUERY_FIELDS)

    def pred(p: Pred):
        if p.key not in QUERY_FIELDS:
            out.append(f"unknown field {p.key!r}")
            return
        for field, known in (("status", STATUSES), ("needs", NEEDS), ("class", classes)):
            if p.key == field:
                out.extend(f"unknown {field} {v!r}" for v in p.values if v not in known)
        if p.key in DATE_FIELDS:
            out.extend(f"{p.key} expects a date or now, got {v!r}" for v in p.values if v != "now" and not _DATE.fullmatch(v))
        if p.key in FLAG_FIELDS and p.op != "has":
            if p.op not in ("=", "!="):
                out.append(f"{p.key} is a flag: it takes = and != only")
            out.extend(f"{p.key} expects true or false, got {v!r}" for v in p.values if v not in ("true", "false"))
        if p.key == "value" and p.op != "has":
            for v in p.values:
                try:
                    float(v)
                except ValueError:
                    out.append(f"value expects a number, got {v!r}")

    def walk(q):
        if isinstance(q, (And, Or)):
            for t in q.terms:
                walk(t)
        elif isinstance(q, Not):
            walk(q.inner)
        elif isinstance(q, Scoped):
            walk(q.inner)
            sorts(q.sort)
        elif isinstance(q, Pattern):
            for a in q.atoms:
                out.extend(f"unknown kind {k!r}" for k in a.kinds if k not in KINDS)
                for p in a.preds:
                    pred(p)
            out.extend(f"unknown edge type {h.edge!r}" for h in q.hops if h.edge not in CORE_EDGES and h.edge not in extra_edges)
            sorts(q.sort)

    walk(query)
    return out


def as_json(query) -> dict:
    """A query as plain dicts and lists, each with its node's type."""
    return {"type": type(query).__name__, **{k: v if not hasattr(getattr(query, k), "__dataclass_fields__") else as_json(getattr(query, k)) for k, v in asdict(query).items() if k not in ("terms", "inner")}, **({"terms": [as_json(t) for t in query.terms]} if isinstance(query, (And, Or)) else {}), **({"inner": as_json(query.inner)} if isinstance(query, (Not, Scoped)) else {})}
