"""Personal data by candidate gradient boosting.

Exact patterns give the base spans (e-mail, IPv4, payment card, phone with a country code). High-recall generators propose
further, overlapping spans of other kinds: e-mail in words, phone without a plus sign, social security number, IBAN, IPv6 and
secrets. Boosted trees score each proposal by its format and its context; thresholds, calibrated per kind to ``PRECISION``, select those
that are added. The trees are trained here: a seeded generator writes labelled spans of both kinds into windows of the documents
themselves, at most ``WINDOWS`` of them with the least hashes. A third of the windows trains the trees, a third sets the thresholds and
a third measures precision and recall (:func:`quality`). Base spans always stay, and added spans never overlap them or each other.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import tidy

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_text", "phone_local", "ssn", "iban", "ipv6", "secret")
KINDS = BASE + ADDED
PRECISION = 0.99
#: Windows of the documents, of WIDTH characters, into which the examples are written, at most.
WINDOWS, WIDTH = 3000, 160
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs: the same leftmost matches without quadratic retries
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the check sum of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    """Its ASCII digits."""
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact spans (kind, start, end), by kind in the order of BASE, then by start."""
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            low = at
            while low > end and text[low - 1] in _LOCAL:
                low -= 1
            if low < at:
                out.append(("email", low, m.end()))
                end = m.end()
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}"
_GENERATORS = [
    ("email_text", re.compile(rf"{_NAME} ?[\[(<{{]? ?(?:at|AT|@) ?[\])>}}]? ?{_NAME}(?: ?[\[(<{{]? ?(?:dot|DOT|\.) ?[\])>}}]? ?[A-Za-z]{{2,12}}){{1,3}}(?![A-Za-z])")),
    ("phone_local", re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-]?|0[0-9]{2,4}[ ./-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("ipv6", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{12,}+={0,2}(?![A-Za-z0-9+/_=-])")),
]
_CLUE = {
    "email_text": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b"),
    "phone_local": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|tél|whatsapp)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|transfer|cuenta|compte)\b"),
    "ipv6": re.compile(r"(?i)\b(?:ip|ipv6|host|server|addr|address|client)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|passw|pwd|api[_-]?key|\bkey\b|credential|auth)"),
}
_AGAINST = re.compile(r"(?i)\b(?:order|invoice|version|isbn|page|figure|table|total|sum|score|commit|sha|md5|hash|digest|item|part|model|row|line|chapter|ratio)\b")


def _proposals(text: str) -> list[tuple[str, int, int]]:
    """All spans that the generators propose; they may overlap."""
    digits = any(c in text for c in "0123456789")
    out = []
    for kind, pattern in _GENERATORS:
        if kind == "email_text":
            if not re.search(r"(?i)[\[(<{ ](?:dot)[\])>} ]|[\[(<{] ?at ?[\])>}]|\(@\)|\[@\]", text):
                continue
        elif not digits or kind == "ipv6" and ":" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "secret" and not re.search(r"[0-9]", m.group()):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in (s.count(x) for x in set(s)))


def _mod97(s: str) -> bool:
    s = "".join(c for c in s.upper() if c.isalnum())
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1 if s.isascii() and s.isalnum() else False


def _described(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of one proposal."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    n, d = len(s), digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    return [
        *(float(kind == k) for k in ADDED),
        n, len(d), len(d) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, sum(not c.isalnum() for c in s), _entropy(s), len(set(s)) / n,
        len(groups), float(max(map(len, groups), default=0)), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(bool(_CLUE[kind].search(before))), float(bool(_AGAINST.search(before))), float(before.rstrip()[-1:] in ("=", ":")), float(before[-1:] in ('"', "'", "`")), float(after[:1] in ('"', "'", "`")), float(before[-1:].isalnum()), float(before[-1:] in (".", ",", "$", "€", "#", "/")),
        float(kind == "iban" and _mod97(s)), float(kind == "ssn" and groups[0] not in ("000", "666") and groups[0][0] != "9" and groups[1] != "00" and groups[-1] != "0000"),
        float("::" in s), float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))), float(any(c in s for c in "()[]")), float(bool(re.search(r"(?i)\b(?:dot|at)\b", s))),
        float(len(re.findall(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]", s))), float(bool(re.fullmatch(r"[0-9]{4}[-/. ][0-9]{2}[-/. ][0-9]{2}.*", s))),
    ]


class Trees:
    """Gradient-boosted regression trees for log odds, over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 24, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        p = float(y.mean())
        self.start = math.log(p / (1 - p))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(tree, 0, np.arange(len(y)), binned, cuts, g, h, self.depth)
            self.trees.append(tree)
            f += self._run(tree, x)
        return self

    def _grow(self, tree, at, rows, binned, cuts, g, h, depth) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree[at] = (-1, 0.0, self.rate * total_g / (total_h + 1.0))
        best = (1e-3, -1, -1)
        if depth:
            for j, q in enumerate(cuts):
                if not len(q):
                    continue
                cg = np.cumsum(np.bincount(binned[rows, j], g[rows], len(q) + 1))[:-1]
                ch = np.cumsum(np.bincount(binned[rows, j], h[rows], len(q) + 1))[:-1]
                gain = cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - total_g**2 / (total_h + 1.0)
                gain[(ch < self.least / 4) | (total_h - ch < self.least / 4)] = -1
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), j, k))
        if best[1] >= 0:
            _, j, k = best
            tree[at] = (j, float(cuts[j][k]), 0.0)
            go = binned[rows, j] <= k
            self._grow(tree, 2 * at + 1, rows[go], binned, cuts, g, h, depth - 1)
            self._grow(tree, 2 * at + 2, rows[~go], binned, cuts, g, h, depth - 1)

    def _run(self, tree, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        for _ in range(self.depth):
            j = feature[at]
            inner = j >= 0
            left = x[np.arange(len(x)), np.maximum(j, 0)] <= cut[at]
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return value[at]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """The probability of each row."""
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self._run(tree, x)
        return 1 / (1 + np.exp(-f))


_WORDS = "the of and for with this that from report market garden river window paper system people music water number people state light".split()


def _examples(seed: int, count: int, windows: tuple[str, ...] = ()) -> list[tuple[str, str, int, int, bool]]:
    """Labelled spans (text, kind, start, end, personal) from templates, written at a space of one of the windows or between plain words.

    A quarter of the personal spans lacks a clue and a twentieth of the others has a false one, so that formats alone don't decide.
    """
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    word = lambda: rng.choice(_WORDS)
    mixed = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", k=n))

    def iban():
        body = num(rng.choice([12, 14, 16, 18]))
        land = rng.choice(["DE", "FR", "ES", "NL", "GB"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def secret():
        return rng.choice([hexa(rng.choice([32, 40, 48, 64])), mixed(rng.randint(16, 44)), "sk_live_" + mixed(24), "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))])

    good = {
        "email_text": lambda: rng.choice([f"{word()}{num(2)} at {word()} dot com", f"{word()} (at) {word()} (dot) org", f"{word()}.{word()}[at]{word()}[dot]net", f"{word()} [at] {word()}.com"]),
        "phone_local": lambda: rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]),
        "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": iban,
        "ipv6": lambda: rng.choice([":".join(hexa(4) for _ in range(8)), f"2001:db8:{hexa(4)}::{hexa(4)}", f"fe80::{hexa(4)}:{hexa(4)}:{hexa(3)}:{hexa(4)}"]),
        "secret": secret,
    }
    clue = {
        "email_text": ["write to", "contact", "mail", "reach me:"],
        "phone_local": ["call", "phone:", "tel.", "my mobile is", "fax"],
        "ssn": ["SSN", "social security number", "ssn:"],
        "iban": ["IBAN", "bank account", "transfer to"],
        "ipv6": ["client address", "server", "from host"],
        "secret": ['token = "', "api_key=", 'password: "', "secret = ", "auth token "],
    }
    bad = {
        "email_text": lambda: rng.choice([f"{word()} at {word()} dot {word()}", f"look at {word()} dot matrix", f"{word()} at ten dot com era", f"meet (at) noon. {word().capitalize()}"]),
        "phone_local": lambda: rng.choice([f"{rng.randint(1900, 2030)}-{num(4)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(2)}", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}-{num(2)}", f"{num(4)} {num(4)}", f"20{num(2)}.{num(4)}.{num(2)}", f"{num(2)} {num(3)}{num(3)}"]),
        "ssn": lambda: rng.choice([f"000-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"{num(3)} {num(2)} {num(4)}"]),
        "iban": lambda: f"{rng.choice(['AB', 'XY', 'DE', 'FR', 'NO'])}{num(2)} {num(4)} {num(4)} {num(rng.randint(1, 4))}",
        "ipv6": lambda: rng.choice([f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(2)}", f"{num(1)}:{num(1)}:{num(1)}:{num(1)}"]),
        "secret": lambda: rng.choice([f"{word()}-{word()}-{num(4)}", f"{word()}{word()}{num(1)}x{word()}", f"{num(14)}", f"20{num(2)}-{num(2)}-{num(2)}-{word()}", hexa(40), f"{word()}_{word()}_{num(2)}_{word()}", f"/{word()}/{word()}/{num(3)}/{word()}", num(16)]),
    }
    against = ["order", "version", "page", "commit", "table", "figure", "total", "item", "sha", "part", "score"]
    out = []
    for _ in range(count):
        kind = rng.choice(ADDED)
        yes = rng.random() < 0.45
        s = (good if yes else bad)[kind]()
        lead = rng.choice(clue[kind]) if rng.random() < (0.75 if yes else 0.05) else rng.choice(["", *against]) if not yes or rng.random() < 0.1 else ""
        whole = rng.choice(windows) if windows else " ".join(rng.choices(_WORDS, k=14))
        cuts = [m.start() for m in re.finditer(r"\s", whole)] or [0]
        cut = rng.choice(cuts)
        text = f"{whole[:cut]} {lead}".strip()
        text = text + ("" if text[-1:] in ('"', "=") else " " if text else "")
        start = len(text)
        text = text + s + ('"' if '"' in lead else "") + rng.choice([" ", ". ", ", "]) + whole[cut:].lstrip()
        out.append((text, kind, start, start + len(s), yes))
    return out


def _table(examples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the proposals that touch the examples' spans."""
    x, y, kinds = [], [], []
    for text, kind, start, end, yes in examples:
        for k, a, b in _proposals(text):
            if a < end and b > start:
                x.append(_described(text, k, a, b))
                y.append(float(yes and k == kind and a <= start + 1 and b >= end - 1))
                kinds.append(k)
    return np.array(x, float), np.array(y), np.array(kinds)


@lru_cache(maxsize=4)
def trained(windows: tuple[str, ...] = ()) -> tuple[Trees, dict[str, float]]:
    """The trees, and for each kind the least probability at which PRECISION of the calibration examples are right (1.1: never).

    For precision the examples that are personal and those that are not weigh alike in each kind.
    """
    x, y, _ = _table(_examples(11, 4000, windows[0::3]))
    trees = Trees().fit(x, y)
    x, y, kinds = _table(_examples(12, 4000, windows[1::3]))
    p, least = trees.odds(x), {}
    for kind in ADDED:
        q, t = p[kinds == kind], y[kinds == kind]
        order = np.argsort(-q, kind="stable")
        hits, wrong = np.cumsum(t[order]), np.cumsum(1 - t[order]) * t.sum() / max(1.0, (1 - t).sum())
        good = np.flatnonzero((hits >= PRECISION * (hits + wrong)) & (t[order] > 0))
        least[kind] = float(q[order][good[-1]]) if len(good) else 1.1
    return trees, least


def quality(windows: tuple[str, ...] = (), seed: int = 13, count: int = 4000) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each added kind on examples in the third of the windows that neither training nor calibration sees.

    Both classes weigh alike in the precision.
    """
    trees, least = trained(windows)
    x, y, kinds = _table(_examples(seed, count, windows[2::3]))
    taken = trees.odds(x) >= np.array([least[k] for k in kinds])
    out = {}
    for kind in ADDED:
        own = kinds == kind
        good, bad = own & (y > 0), own & (y == 0)
        recall, false = float(taken[good].mean()) if good.any() else 0.0, float(taken[bad].mean()) if bad.any() else 0.0
        out[kind] = (recall / max(1e-12, recall + false), recall)
    return out


def windows_of(docs: DataFrame) -> tuple[str, ...]:
    """At most WINDOWS windows of ``docs(text)``: those of the texts with the least hashes, each text once, from a place that its hash picks."""
    h = F.xxhash64("text")
    size = F.char_length("text")
    at = (F.pmod(F.shiftright(h, 16), F.greatest(size - WIDTH, F.lit(1))) + 1).cast("int")
    rows = docs.where(size > 20).select(h.alias("h"), F.substring(F.col("text"), at, F.lit(WIDTH)).alias("w")).distinct().orderBy("h", "w").limit(WINDOWS).collect()
    return tuple(" ".join(r["w"].split()) for r in rows)


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the places that spans cover, sorted and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _free(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether [a, b) touches none of the sorted places."""
    k = bisect.bisect_right(starts, a)
    return (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b)


def all_spans(texts: list[str], trees: Trees, least: dict[str, float]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base, found, x = [base_spans(t) for t in texts], [], []
    for k, t in enumerate(texts):
        starts, ends = _union(base[k])
        for kind, a, b in _proposals(t):
            if _free(starts, ends, a, b):
                found.append((k, kind, a, b))
                x.append(_described(t, kind, a, b))
    added: list[list] = [[] for _ in texts]
    if found:
        p = trees.odds(np.array(x, float))
        places: list[tuple[list[int], list[int]]] = [([], []) for _ in texts]
        for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i])):
            k, kind, a, b = found[i]
            starts, ends = places[k]
            if p[i] >= least[kind] and _free(starts, ends, a, b):
                added[k].append((kind, a, b))
                at = bisect.bisect_right(starts, a)
                starts.insert(at, a)
                ends.insert(at, b)
    return [(b, sorted(a, key=lambda s: (KINDS.index(s[0]), s[1]))) for b, a in zip(base, added, strict=True)]


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """The spans of each row of ``docs(doc_id, text)``, in code points with the end exclusive.

    n_email, n_ip, n_card and n_phone count base spans and base_sha256 is over them; ``spans`` has the added ones too. Null texts
    count as empty and have no spans; repeated rows have equal results; other columns are ignored; no rows give no rows.
    """
    import hashlib

    import pyarrow as pa

    trees, least = trained(windows_of(docs))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for base, added in all_spans(part.column(1).to_pylist(), trees, least):
                    n = [sum(k == kind for k, _, _ in base) for kind in BASE]
                    out.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=[c.split()[0] for c in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), SPANS)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the column ``text`` replaced by its kind in angle brackets; null texts stay null."""
    import pyarrow as pa

    trees, least = trained(windows_of(docs.select(F.col(text).alias("text"))))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raw = part.column(at).to_pylist()
                out = []
                for t, (base, added) in zip(raw, all_spans([t or "" for t in raw], trees, least), strict=True):
                    pieces, end = [], 0
                    for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
                        if s >= end:
                            pieces += [t[end:s], f"<{kind}>"]
                        end = max(end, e)
                    out.append(t if t is None else "".join(pieces) + t[end:])
                cols = [pa.array(out, part.column(c).type) if c == at else part.column(c) for c in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
