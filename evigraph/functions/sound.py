"""Names by sound, and passages by longest common subsequence: the two text functions that need Python (Arrow batches)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Consonants that sound alike (fixed values).
_SOUNDS = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
_DIGIT = {c: d for d, letters in _SOUNDS.items() for c in letters}
KEY_LENGTH, NAME_EDITS = 6, 2
NEAR_RATIO = 0.75


def sound_of(word: str) -> str:
    """First letter and the classes of the consonants that follow, up to six signs; empty for words with digits or under three letters."""
    low = word.lower()
    letters = [c for c in low if "a" <= c <= "z"]
    if len(letters) < 3 or any(c.isascii() and c.isdigit() for c in low):
        return ""
    classes = [_DIGIT.get(c, "") for c in letters]
    kept = [c for before, c in zip(classes, classes[1:]) if c and c != before]
    return (letters[0] + "".join(kept))[:KEY_LENGTH]


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_keys(names: pd.Series) -> pd.Series:
    """The sound keys of a name's words; NULL if a word has none."""

    def keys(name):
        found = [sound_of(w) for w in re.findall("[A-Za-z0-9]+", name or "")]
        return found if found and all(found) else None

    return names.map(keys)


def sound_alike(a: Column, b: Column) -> Column:
    """Whether two names have equal keys word by word and each word pair is within two edits."""
    ws = [F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "") for x in (a, b)]
    near = F.zip_with(*ws, lambda x, y: F.levenshtein(x, y, NAME_EDITS) >= 0)
    return F.coalesce((name_keys(a) == name_keys(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def quote_words(text: str) -> list[str]:
    """Letters and digits by word in lower case, without page stars."""
    return re.findall(r"[^\W_]+", re.sub(r"\*[0-9]+", " ", text or "").lower())


def subsequence_ratio(a: list[str], b: list[str]) -> float:
    """Twice the longest common subsequence over the summed lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def near_passage(quote: str, text: str) -> tuple[str | None, float]:
    """(the passage nearest to a quotation around its longest words, its ratio); no passage under NEAR_RATIO or for under four words."""
    q = quote_words(quote)
    if len(q) < 4:
        return None, 0.0
    t = quote_words(text)
    anchors = sorted({w: None for w in q if len(w.encode()) >= 6}, key=lambda w: -len(w.encode()))[:3]
    places: dict[str, list[int]] = {}
    for k, w in enumerate(q):
        if w in anchors:
            places.setdefault(w, []).append(k)
    best, where = 0.0, None
    for start in sorted({max(0, k - off) for k, w in enumerate(t) if w in places for off in places[w]}):
        window = t[start : start + len(q)]
        r = subsequence_ratio(q, window)
        if r > best:
            best, where = r, window
    return (" ".join(where), best) if where and best >= NEAR_RATIO else (None, best)


@F.pandas_udf(T.StructType([T.StructField("passage", T.StringType()), T.StructField("ratio", T.DoubleType())]))
def near_miss(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """:func:`near_passage` of each row."""
    return pd.DataFrame([near_passage(q, t) for q, t in zip(quotes, texts, strict=True)], columns=["passage", "ratio"])


@F.pandas_udf(T.StringType())
def shortest_number(values: pd.Series) -> pd.Series:
    """A number in the shortest form with up to 17 digits and an exponent outside 1e-4 to 1e21, NULL as empty."""

    def form(x):
        if pd.isna(x):
            return ""
        s = repr(float(x))
        mantissa, _, exp = f"{float(x):e}".partition("e")
        digits = s.replace("-", "").replace(".", "").partition("e")[0].strip("0") or "0"
        e = int(exp)
        sign = "-" if s.startswith("-") else ""
        if -4 <= e < 21:
            if e >= len(digits) - 1:
                return sign + digits + "0" * (e - len(digits) + 1)
            return sign + (digits[: e + 1] + "." + digits[e + 1 :] if e >= 0 else "0." + "0" * (-e - 1) + digits)
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"

    return values.map(form)
