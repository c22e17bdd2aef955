"""The Kneser-Ney model against a plain dictionary version."""

import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

from evigraph.llm.ngram import discounts, train_and_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1


def brute(rows):
    learned = [tokens(t) for d, t in rows if crc(d) % 10]
    c = Counter(x for t in learned for x in t)
    pairs = Counter(p for t in learned for p in zip(["<s>", *t], t))
    n, v = sum(c.values()), len(c)
    before, follow, total = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in pairs.items():
        before[b] += 1
        follow[a][min(k, 3)] += 1
        total[a] += k
    hist = lambda m: [sum(1 for x in m.values() if x == k) for k in (1, 2, 3, 4)]
    dh, dl = [0.0, *discounts(hist(pairs))], [0.0, *discounts(hist(before))]
    types = sum(before.values())
    low = Counter(min(x, 3) for x in before.values())
    rest = sum(dl[k] * low[k] for k in (1, 2, 3)) / types if types else 1.0

    def p1(w):
        return (max(before[w] - dl[min(before[w], 3)], 0) / types if types else 0) + rest / (v + 1)

    def p2(a, w):
        if not total[a]:
            return p1(w)
        k = pairs[(a, w)]
        gamma = sum(dh[j] * follow[a][j] for j in (1, 2, 3)) / total[a]
        return max(k - dh[min(k, 3)], 0) / total[a] + gamma * p1(w)

    out = {}
    for d, text in rows:
        t = tokens(text)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        score = sum(math.log10(p2(a, w)) for a, w in zip(["<s>", *t], t))
        out[d] = (crc(d) % 10 == 0, len(t), sum(1 for x in t if c[x]), n, base, score)
    vocab = [*c, "never seen"]
    for a in ["<s>", *list(c)[:5], "never seen"]:
        assert abs(sum(p2(a, w) for w in vocab) - 1) < 1e-9
    return out


def check(spark, rows):
    want = brute(rows)
    got = train_and_score(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9), (r, w)


def test_against_dictionaries(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "One one ONE two\x0bthree"), (None, "null id"), (5, "hot " * 3000 + "É é"), (6, "a b a b"), (7, "zz y"), (0, "one b unknown")])


def test_counts_of_more_than_32_bits(tmp_path):
    """A model's files hold counts of any size."""
    import numpy as np

    from evigraph.llm.common import put_file
    from evigraph.llm.ngram import Model

    where, many = str(tmp_path), 2**40 + 7
    files = {
        "words/0.keys": np.array([5, 9], np.uint64), "words/0.counts": np.array([many, 1], np.uint64), "pairs/0.keys": np.array([0, 1], np.uint64),
        "pairs/0.counts": np.array([3, 255], np.uint8), "pairs/0.at": np.array([1], np.uint32), "pairs/0.more": np.array([many], np.uint64),
        "pairs/0.contexts": np.array([[many + 3, 0, 0, 2], [0, 0, 0, 0], [0, 0, 0, 0]], np.uint64),
    }
    for name, values in files.items():
        put_file(f"{where}/{name}", [values.tobytes()])
    model = Model(where, {"words": [2], "parts": [1], "pairs": [2], "tokens": many + 1})
    assert model.word_values("counts", np.array([1, 0, -1])).tolist() == [1, many, 0]
    assert model.pair_counts(np.array([0, 0]), np.array([1, 0])).tolist() == [many, 3]
    assert model.context(np.array([0])).tolist() == [[many + 3, 0, 0, 2]]


def test_empty(spark):
    assert train_and_score(spark.createDataFrame([], DOCS)).collect() == []
    check(spark, [(18, "only held out")] if crc(18) % 10 == 0 else [(1, "x")])
