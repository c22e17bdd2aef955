"""The pipeline's stages on a small corpus against what brute force keeps, and on odd and empty tables."""

import zlib

import pytest
from pyspark.sql import types as T

import corpus_pipeline as cp
from evigraph.llm.decontam import plain
from evigraph.llm.packing import combinations, nnls
from tests.llm.test_near_dup import shingles

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LEAK = "which of the following rivers runs through the old town before it meets the northern sea"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = lambda k: " ".join(f"plain{(k * 7 + j * 13) % 911} words about matter {j * k % 17}" for j in range(12))
    rows = [(k, good(k), "en", "s", 1) for k in range(60)]
    rows += [(100 + k, "BUY!! NOW!! CHEAP!! %%% " * 9 + str(k), "en", "s", 1) for k in range(30)]
    rows += [(200 + k, good(k) + " end", "en", "s", 1) for k in range(5)] + [(300, good(70) + " " + LEAK + " " + good(71), "en", "s", 1)]
    rows += [(400, good(80) + " write to joe.b@mail.example.com or +1 (212) 555-0182", "en", "s", 1), (5, good(5), "en", "s", 1), (None, good(90), None, None, None), (401, None, "en", "s", None), (402, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(30)], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], ITEMS).write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.createDataFrame(rows, DOCS)
    kept = cp.quality_stage(spark, docs, d)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and not ids & set(range(100, 130))
    single = cp.near_duplicate_stage(spark, kept, d)
    left = [r for r in single.collect() if r["doc_id"] is not None]
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect() if r["doc_id"] is not None}
    gone = {a for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert sorted(r["doc_id"] for r in left) == sorted(set(sets) - gone)
    clean = cp.decontamination_stage(spark, single, d)
    want = {r["doc_id"] for r in single.collect() if plain(LEAK) not in plain(r["text"] or "")}
    assert {r["doc_id"] for r in clean.collect()} == want and 300 not in want
    safe = cp.pii_stage(spark, clean, d)
    text = {r["doc_id"]: r for r in safe.collect()}
    if 400 in text:
        assert "<email>" in text[400]["text"] and "<phone>" in text[400]["text"] and text[400]["n_chars"] == len(text[400]["text"])
    assert text[1]["text"] == next(t for k, t, *_ in rows if k == 1)
    packed = cp.packing_stage(spark, safe, d).collect()
    assert sum(r["length"] for r in packed) == sum({(r["doc_id"]): r["doc_tokens"] for r in packed}.values())


def test_extra_columns_stay_as_they_are(spark, folder):
    d, rows = folder
    extra = ["score", "kept_id", "whole_text", "label", "labelled", "s", "component_id", "idx", "ids", "n", "Kept", "__text"]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"concat('{c} ', doc_id) as `{c}`" for c in extra))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [f.name for f in DOCS.fields] + extra
        got = docs.collect()
        assert got and all(r[c] == (None if r["doc_id"] is None else f"{c} {r['doc_id']}") for r in got for c in extra)
        docs = spark.createDataFrame(got, docs.schema)
    assert cp.packing_stage(spark, docs, d).count() >= docs.count()


def test_rows_of_one_id_with_other_texts_stay(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "quite another text of some few words"), (2, text + " end")], T.StructType(DOCS.fields[:2]))
    assert sorted((r["doc_id"], len(r["text"])) for r in cp.near_duplicate_stage(spark, docs, "").collect()) == [(1, 36), (1, len(text))]


def test_near_copies_from_80_percent_go(spark):
    rows = []
    for k in range(120):
        words = [f"w{k}x{j}" for j in range(104)]
        # a change of the last c words loses c of 100 shingles: similarities from 0.74 to 0.90 about the threshold
        c = 5 + k % 11
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-c] + [f"other{k}y{j}" for j in range(c)]))]
    docs = spark.createDataFrame(rows, T.StructType(DOCS.fields[:2]))
    sets = {d: shingles(t) for d, t in rows}
    score = {k: 100 * len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(120)}
    assert sum(80 <= x < 85 for x in score.values()) > 20 and sum(x < 80 for x in score.values()) > 20
    left = {r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, "").collect()}
    assert left == {2 * k for k in range(120)} | {2 * k + 1 for k, x in score.items() if x < 80}


def test_run_and_empty(spark, folder, tmp_path):
    d, _ = folder
    assert cp.run(spark, d).count() > 0
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    from evigraph.llm.packing import pack_documents
    from evigraph.llm.queries import tokenizer_path

    texts = [None, "", "a", "Don't STOP, it's 2024!", "word " * 9000, "日本語 œuvre", "<|endoftext|> x", "é" * 300] + [f"text number {k} " * (k % 40) for k in range(300)]
    docs = spark.createDataFrame([(k if k != 3 else None, t) for k, t in enumerate(texts)], T.StructType(DOCS.fields[:2])).selectExpr("*", "doc_id as shard", "text as ids")
    rows = pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for k, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        got = b"".join(bytes(r["ids"]) for r in sorted(by[k if k != 3 else None], key=lambda r: r["start"]))
        assert got == b"".join(x.to_bytes(4, "little") for x in want)
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(seq) <= sum(r["length"] for r in rows) / 4096 * 1.1 + 2


def test_least_squares():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-6).all() and abs(g[x > 1e-9]).max(initial=0) < 1e-6
    assert all(sum(c) == 9 and len(c) <= 3 for c in combinations(9, 3)) and len(combinations(9, 3)) == 12
