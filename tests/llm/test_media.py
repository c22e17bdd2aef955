"""Round trips of stored payloads, order and captions of parts, and the join by digest."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from evigraph.llm import media


def test_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 128, 5000):
        raw = media.padded(bytes(rng.randrange(256) for _ in range(n)))
        assert len(raw) % 64 == 0 and raw
        assert media.decode(media.encode(raw)).tobytes() == raw
    broken = bytearray(media.encode(media.padded(b"abc")))
    broken[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(broken))


def test_parts():
    parts = media.parse('<p>One &amp; <b>two</b></p><img src="sha256:aa" alt="A"><p>three<figure><img src="sha256:bb"><img src="x"><figcaption>Both\n of them</figcaption></figure>tail<script>no</script>')
    assert [(p["position"], p["kind"], p["text"] or p["digest"], p["caption"]) for p in parts] == [(0, "text", "One & two", None), (1, "media", "aa", "A"), (2, "text", "three", None), (3, "media", "bb", "Both of them"), (4, "media", "x", "Both of them"), (5, "text", "tail", None)]
    assert media.parse(None) == media.parse("") == []


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    rows = [(1, None), (2, ""), (3, "é" * 40), (4, "é" * 40), (4, "é" * 40), (None, "x" * 64), (5, "long text " * 50_000), (6, "a"), (7, "a\0")]
    got = media.documents_as_media(spark.createDataFrame(rows, schema).selectExpr("*", "doc_id as key", "text as digest")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted((d or 0, len((t or "").encode())) for d, t in rows)
    for r in got:
        raw = media.padded((next(t for d, t in rows if d == r["doc_id"]) or "").encode())
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["payload_bytes"] == len(raw) and r["tail_crc32"] == zlib.crc32(raw[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.encode(raw)).hexdigest() and r["media_bytes"] == len(media.encode(raw)) and r["feature"]
    assert media.documents_as_media(spark.createDataFrame([], schema)).count() == 0


def test_missing_payload(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:none">')], "page_id long, html string")
    about = media.described(media.store(spark.createDataFrame([(bytearray(64),)], "payload binary")))
    row = media.resolve(media.sequences(pages), about).first()
    assert row["ref"] == "none" and row["payload_bytes"] is None
