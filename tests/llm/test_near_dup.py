"""Near-duplicate classes against brute force over all pairs."""

import random
import re

from pyspark.sql import types as T

from evigraph.llm.near_dup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                up[root(i)] = root(j)
    out = []
    for i, (d, x) in enumerate(sets):
        least = min((sets[j][0] for j in range(len(rows)) if root(j) == root(i) and sets[j][0] is not None), default=None)
        out.append((d, len(x), least, d == least if d is not None else True))
    return sorted(out, key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 8, 40, 120, 300]))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "  "]).join(w)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, extra=False):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    if extra:
        for c in ("s", "key", "component_id", "rep"):
            df = df.withColumn(c, df.doc_id)
    return sorted([tuple(r) for r in near_duplicates(df).collect()], key=repr)


def test_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"), (6, "É x y z w"), (7, "é x y z w"), (9, "a " * 5000), (8, "a " * 6000), (None, None)]
    assert run(spark, rows, extra=True) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_large_buckets_with_several_components(spark, monkeypatch):
    """Small blocks, so that buckets are parted into their largest component and the rest; families drift apart and share openings."""
    import evigraph.llm.near_dup as nd

    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(3)
    rows = []
    for family in range(6):
        base = [f"w{k}" for k in range(140)] + [f"f{family}v{k}" for k in range(22 if family else 0)]
        for _ in range(40 if not family else 12):
            w = list(base)
            for _ in range(3):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = run(spark, rows)
    assert got == brute(rows) and len({r[2] for r in got}) > 1


def test_family_of_copies(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_pairs_at_the_threshold_are_found(spark):
    """3,000 pairs of similarity 0.85 to 0.88: with a miss of 1e-5 a pair, none of them goes astray."""
    rng = random.Random(8)
    rows, linked = [], 0
    for k in range(3000):
        n = rng.randint(60, 120)
        words = [f"w{k}x{j}" for j in range(n + 4)]
        c = int(n * rng.uniform(0.065, 0.081))  # a change of the last c words loses c of n shingles
        linked += 100 * (n - c) >= 85 * (n + c)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-c] + [f"y{k}z{j}" for j in range(c)]))]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert linked > 2000 and sum(got[2 * k + 1] == 2 * k for k in range(3000)) == linked
