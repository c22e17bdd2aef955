"""Leak search against the plain dynamic programme over every window."""

import random

from pyspark.sql import types as T

from evigraph.llm import decontam
from evigraph.llm.decontam import Matcher, _original, distances, find_leaks, masks, pieces, plain, without_leaks


def table(item, text):
    """Least distance of item to a substring ending at each place."""
    row = list(range(len(item) + 1))
    best = [row[-1]]
    for c in text:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (x != c)))
        row = new
        best.append(row[-1])
    return best


def test_myers_and_pieces():
    rng = random.Random(4)
    for _ in range(300):
        item = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(1, 120)))
        assert list(distances(masks(item), len(item), text)) == table(item, text)[1:]
        edit = list(range(len(item) + 1))
        whole = []
        for i, c in enumerate(text):
            new = [i + 1]
            for k, x in enumerate(item):
                new.append(min(new[-1] + 1, edit[k + 1] + 1, edit[k] + (x != c)))
            edit = new
            whole.append(edit[-1])
        assert list(distances(masks(item), len(item), text, True)) == whole
        spans = pieces(item, 0.1)
        assert "".join(item[a:b] for a, b in spans) == item and len(spans) == int(len(item) * 0.1) + 1


def test_finds_every_text_within_budget():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    items = tuple((k, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for k in range(12))
    m = Matcher(items, 0.1)
    for _ in range(200):
        i = rng.randrange(len(items))
        s = list(items[i][1])
        for _ in range(rng.randint(0, int(len(s) * 0.13))):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], ["z"], [s[k], "y"]])
        text = plain(" ".join(rng.choices(words, k=20)) + " " + "".join(s) + " " + " ".join(rng.choices(words, k=20)))
        found = {x[0] for x in m.find(text)}
        want = {j for j, (_, item) in enumerate(items) if min(table(item, text)) <= int(len(item) * 0.1)}
        assert found == want
        for j, a, b, d in m.find(text):
            assert table(items[j][1], text[a:b])[-1] == d


def places(item, text, rate):
    """The places by the dynamic programme alone: the first end within the budget, the best of the next k, the nearest start; then on behind it."""
    k, at, out = int(len(item) * rate), 0, []
    while True:
        row = table(item, text[at:])[1:]
        first = next((j for j, d in enumerate(row) if d <= k), None)
        if first is None:
            return out
        ends = row[first : first + k + 1]
        end = at + first + ends.index(min(ends)) + 1
        start = next(a for a in range(end - 1, at - 1, -1) if table_whole(item, text[a:end]) == min(ends))
        out.append((start, end, min(ends)))
        at = end


def table_whole(item, text):
    row = list(range(len(item) + 1))
    for i, c in enumerate(text):
        new = [i + 1]
        for k, x in enumerate(item):
            new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (x != c)))
        row = new
    return row[-1]


def test_every_place_of_periodic_items_and_neighbours():
    rng = random.Random(12)
    items = ["the cat the cat the cat the cat the cat the cat the cat the cat", "abababababababababababababab", "the quick brown fox jumps over the lazy dog", "aab" * 9]
    for n in range(240):
        item = items[n % 4]
        rate = rng.choice([0.08, 0.15])
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = list(item)
            for _ in range(rng.randint(0, int(len(s) * rate) + 1)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], ["z"], [s[k], "y"]])
            parts.append("".join(s))
            if rng.random() < 0.5:
                parts.append("".join(rng.choices("abz ", k=rng.randint(0, 30))))
        text = rng.choice(["", " "]).join(parts)
        assert [x[1:] for x in Matcher(((1, item),), rate).find(text)] == places(item, text, rate), (item, text)
    exact = items[0]
    near = exact.replace("cat", "cut", 2)
    found = Matcher(((1, exact),), 0.08).find(near + " " + exact)
    assert [x[3] for x in found] == [2, 0]


def test_short_items_stand_at_word_edges():
    m = Matcher(((1, "art"), (2, "art art")), 0.08)
    assert m.find("party art start art art") == [(0, 6, 9, 0), (0, 16, 19, 0), (0, 20, 23, 0), (1, 16, 23, 0)]


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def test_rows(spark):
    item = "The quick, brown fox jumps over the lazy dog; and then it sleeps for İ hours."
    docs = [(1, "x " * 4000 + item.upper() + " y" * 4000), (2, None), (3, ""), (4, "quick brown fox"), (None, item), (5, item.replace("brown", "brwn") + " -- " + item)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "doc_id as item_id", "text as start")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(df, spark.createDataFrame([(7, item), (8, None), (9, " .")], ITEMS)).collect()}
    assert {(d, i) for d, i, _ in got} == {(1, 7), (None, 7), (5, 7)}
    assert {x for d, _, x in got if d == 5} == {0, 1}
    for r in find_leaks(df, spark.createDataFrame([(7, item)], ITEMS)).where("doc_id = 1").collect():
        assert docs[0][1][r["start"] : r["end"]] == item.upper()[:-1]
    assert find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    items = [(k, f"item number {k} speaks of river {k * 31} and of town {k * 17}") for k in range(20)]
    docs = [(k, f"so said the text {items[k][1] if k < 20 else ''} at last") for k in range(30)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).where("distance = 0").collect()}
    assert found == {(k, k) for k in range(20)}
    assert {r["doc_id"] for r in without_leaks(df, bench).collect()} == set(range(20, 30))


def test_original_places():
    assert _original("  A--b  ", [(0, 3)]) == [(2, 6)]
