"""Held-out accuracy, the dual descent against its optimality conditions, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import types as T

from evigraph.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.train_and_score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [rng.choice(30, 6, replace=False) for _ in range(80)]
    values = [rng.normal(size=6) for _ in rows]
    y = np.sign(rng.normal(size=80))
    w = quality.descend(rows, values, y, np.ones(80), 30, epochs=500)

    def loss(w):
        return w @ w / 2 + sum(max(0, 1 - t * (w[i] @ v + w[-1])) for i, v, t in zip(rows, values, y, strict=True))

    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=31)) + 1e-6 for _ in range(300))


def test_indicators_are_distinct():
    data = np.frombuffer(("Some text, TEXT text!! " * 50).encode(), np.uint8)
    idx = quality.Indicators().of(data)
    assert sorted(idx) == sorted(set(quality.features(data))) and len(quality.features(np.empty(0, np.uint8))) == 0


def test_parts_of_long_texts_change_nothing():
    rng = np.random.default_rng(3)
    words = ["a", "The", "river", "NOW!!", "12", "3.4", "go", "go", "é", "x" * 30]
    for n in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.integers(0, 80)))
        if n % 5 == 0:
            text += "y" * 90 + " end end end"
        data = np.frombuffer(text.encode(), np.uint8)
        want = sorted(set(quality.features(data)))
        for part in (7, 16, 50, 200):
            assert quality.features_by_parts(data, part).tolist() == want, (text, part)
        assert sorted(quality.Indicators().of(data, most=20)) == want


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a text", 7.0, "w", "x")], "doc_id long, text string, Score double, whole_text string, `odd name` string")
    model = quality.Model(np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), 0.0, 1.0, 0.0)
    got = quality.score(df, model, "other").first().asDict()
    assert got == {"doc_id": 1, "text": "a text", "Score": 7.0, "whole_text": "w", "odd name": "x", "other": 0.5}


def test_odd_rows(spark):
    rows = [(k, ("fine words here " if k % 2 else "BAD!! JUNK!! ") * (k % 7 + 1)) for k in range(200)] + [(None, "x"), (201, None), (202, ""), (1, "fine words here"), (203, "long " * 10**6)]
    labels = [(k, k % 2) for k in range(200)] + [(3, 1), (4, None), (5, 7), (None, 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as score", "text as label", "1 as labelled")
    got = quality.train_and_score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) == bool(r["predicted"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    taught = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 3 != 1)
    one = quality.train_and_score(df, spark.createDataFrame([(taught, 1)], LABELS)).collect()
    assert {round(r["score"], 6) for r in one} == {round(2 / 3, 6)}
    assert quality.train_and_score(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
