"""Base spans against the plain patterns; added spans on examples and clean prose."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import types as T

from evigraph.llm import pii


def simple(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(float(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for k in range(8000):
        s = "".join(rng.choices("0123456789 .-+@a" if k % 3 else "a@.-+1 2(5)_%é\n", k=rng.randint(1, 50)))
        assert simple(s) == pii.base_spans(s), s


def test_added_spans():
    trees, least = pii.trained()
    yes = ["write to jane.doe (at) mail (dot) org soon", "please call (212) 555-0182 today", "his SSN 123-45-6789 is here", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" then', "IBAN DE89 3704 0044 0532 0130 00 please"]
    no = ["the meeting at noon is short", "in 1999-2003 there were 12 345 67 of them", "version 10.2.3 of the order 12345678", "a long-hyphenated-word and internationalisation"]
    assert all(a for _, a in pii.all_spans(yes, trees, least))
    assert not any(b or a for b, a in pii.all_spans(no, trees, least))


def test_added_spans_against_all_pairs():
    """The selection against the plain rule: by odds, none that touches a base span or one taken before."""
    trees, least = pii.trained()
    rng = random.Random(4)
    bits = ["call (212) 555-0182", "SSN 123-45-6789", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "a.b@c.org", "10.0.0.1", "4929348385146306", "+1 (017) 555-7713", "from host 2001:db8:12ab::99ff", "order 555-12-3456", "IBAN DE89 3704 0044 0532 0130 00", "key=" + "aB3" * 200, "word"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(150)]
    for t, (base, added) in zip(texts, pii.all_spans(texts, trees, least), strict=True):
        assert base == pii.base_spans(t)
        apart = lambda s, others: all(s[2] <= o[1] or s[1] >= o[2] for o in others)
        open_ = [s for s in pii._proposals(t) if apart(s, base)]
        odds = trees.odds(np.array([pii._described(t, *s) for s in open_])) if open_ else []
        want: list = []
        for p, s in sorted(zip(odds, open_, strict=True), key=lambda x: (-x[0], x[1])):
            if p >= least[s[0]] and apart(s, want):
                want.append(s)
        assert sorted(want) == sorted(added)


def test_no_text_crashes_or_stalls():
    trees, least = pii.trained()
    rng = random.Random(5)
    texts = ["0" * 5000 + ".1.2.3", "1" * 10000 + ".2" * 9, "a" * 1_000_000, "9" * 1_000_000, "aB3" * 400_000, "1.2.3.4 " * 100_000, "+1" * 200_000, "a@" * 200_000, "4929348385146306 call (212) 555-0182 " * 15_000, "ab:" * 200_000, "at dot " * 100_000, "AA00 " * 100_000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(0x20, 0xD7FF)])) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t, (base, added) in zip(texts, pii.all_spans(texts, trees, least), strict=True):
        assert all(0 <= s < e <= len(t) for _, s, e in base + added)
        if len(t) < 10_000:
            assert base == simple(t)


def test_long_secrets_are_found():
    trees, least = pii.trained()
    rng = random.Random(6)
    for n in (40, 300, 3000):
        token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
        text = f'the river api_key="{token}" of the old town'
        assert pii.all_spans([text], trees, least)[0][1] == [("secret", 19, 19 + n)]


def test_calibration_in_windows_of_documents(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["Thor", "onda", "river,", "12", "of", "the", "cafe.", "night", "1998", "und"], k=80)) for _ in range(400)] + [None, "", "short"]
    docs = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    windows = pii.windows_of(docs)
    assert len(windows) == 400 and windows == pii.windows_of(docs) and all(0 < len(w) <= pii.WIDTH for w in windows)
    _, least = pii.trained(windows)
    assert all(0 < x < 1 for x in least.values()) and len(set(least.values())) > 3
    for kind, (precision, recall) in pii.quality(windows).items():
        assert precision > 0.95 and recall > 0.3, (kind, precision, recall)
    assert pii.windows_of(docs.limit(0)) == () and pii.trained(())


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    rows = [(1, None), (2, ""), (3, "a@b.co and 1.2.3.4"), (3, "a@b.co and 1.2.3.4"), (None, "+1 (212) 555-0182"), (4, "1" * 200000), (5, "é a@b.co " * 20000)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "text as spans", "doc_id as n_ip")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["base_sha256"] == by[2]["base_sha256"] == empty and by[1]["spans"] == ""
    assert by[3]["spans"].startswith("email:0:6,ip:11:18") and by[None]["n_phone"] == 1 and by[5]["n_email"] == 20000
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[3] == "<email> and <ip>" and clean[1] is None
    assert pii.find_pii(spark.createDataFrame([], schema)).count() == 0
